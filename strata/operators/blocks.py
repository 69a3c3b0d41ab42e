"""Blocks of rows as single rows, and pairs of blocks that meet without being copied.

Each block is written once.  A task holds a few blocks of one side and streams those of the
other past them, so what is written grows with both sides, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPREAD = 3  # tasks for each core, if there are so many pairs
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(block: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(block.as_buffer()) as rows:
        return rows.read_all()


def pack(rows: DataFrame, by: list[str], name: str, blocks: int) -> DataFrame:
    """One row for each value of ``by``, with all of its rows as ``name``; ``blocks`` is about how many there are."""

    def one(table: pa.Table) -> pa.Table:
        return pa.table({c: table[c][:1] for c in by} | {name: pa.array([packed(table)], pa.binary())})

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]
    # Dealt by number, so that files and tasks have few blocks each.
    return rows.repartition(blocks, *by).groupBy(*by).applyInArrow(one, ", ".join([*kinds, f"{name} binary"]))


def meet(streamed: DataFrame, held: DataFrame, by: list[str], blocks: int, on: str | None, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Results of ``run`` over pairs of a streamed and a held block, equal in ``on`` if given.

    Tables are written ones; ``held`` has ``blocks`` rows, one for each value of ``by``.  A task gets all pairs of its
    held blocks with all streamed ones that are equal in ``on``; without ``on`` with a share of
    them, and they are shared the less the more blocks are held.
    """
    share = 1 if on else max(1, -(-SPREAD * streamed.sparkSession.sparkContext.defaultParallelism // max(1, blocks)))
    left, right = streamed.coalesce(share), held.repartitionByRange(max(1, blocks), *by).hint("shuffle_replicate_nl")
    pairs = left.crossJoin(right) if on is None else left.join(right, on)
    return pairs.mapInArrow(run, schema)


@contextmanager
def one_by_one(spark: SparkSession) -> Iterator[None]:
    """Python gets a pair of blocks at a time from what runs within."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, "1")
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)
