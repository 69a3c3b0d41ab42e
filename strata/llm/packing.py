"""Packing documents into training sequences, best fit decreasing (operator 12).

A document's ids, with an end id behind them, are first cut into full windows of
``size`` ids; each is a sequence of its own.  What is left of it, shorter than a window,
is packed: items go from longest to shortest, each into the open window with the least
room that still takes it.  A segment tree over room 0 to ``size`` holds which rooms
some open window has, so the tightest one is found in as many steps as the tree is high.

Items are dealt into groups of about ``GROUP`` rows, whatever their number: a group is
packed in one task, and a group's last windows, the only ones that stay rather empty, are few
in its thousand.  Ids are counted and checksummed where they are made and never travel.

Null texts count as empty and have the end id alone.  Repeated rows are packed each; null
ids are ids like any other.  Items of equal length go in order of doc_id and checksum, so
a retried task packs the same way.  Very long texts give as many windows as they fill; a
text that fills its windows exactly leaves nothing to pack.  An empty table gives an
empty result; columns beside doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import released
from strata.llm.tokenfiles import encoder
from strata.storage import materialize

SIZE = 2048
GROUP = 4096
FULL = 1 << 62  # sequences of a single full window are numbered from here


class OpenWindows:
    """Windows by the room they have left; a segment tree over rooms counts them."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()  # rooms 0 to size
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, room: int, change: int) -> None:
        at = self.leaves + room
        while at:
            self.counts[at] += change
            at >>= 1

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._count(room, 1)

    def tightest(self, least: int) -> tuple[int, int] | None:
        """Takes out a window with the smallest room of ``least`` or more: (window, its room)."""
        at = self.leaves + least
        while not self.counts[at]:
            while at & 1:  # right children have nothing beyond them within their parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            at += not self.counts[at]
        room = at - self.leaves
        self._count(room, -1)
        return self.windows[room].pop(), room


def best_fit(lengths: list[int], size: int = SIZE) -> tuple[list[int], list[int]]:
    """Window and offset of each item; ``lengths`` must not increase."""
    opened, found, offsets, many = OpenWindows(size), [], [], 0
    for length in lengths:
        window, room = opened.tightest(length) or (many, size)
        many += window == many
        found.append(window)
        offsets.append(size - room)
        if room > length:
            opened.put(window, room - length)
    return found, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each document's full windows and of its rest."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, end, whole = [], np.array([end_id], np.uint32), encoder(tokenizer)
        for k, text in enumerate(batch.column(1)):
            ids = np.concatenate([whole.encode(text.as_py()), end]).astype("<u4")
            for start in range(0, len(ids), size):
                part = ids[start : start + size]
                rows.append((k, start, len(part), zlib.crc32(part), len(ids)))
        place, *rest = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), *(pa.array(c, pa.int64()) for c in rest)], NAMES)

    step = released(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    # Numbered before they are written, so that what follows sees the same numbers whenever it is run again.
    cut = materialize(pieces(docs, tokenizer, end_id, size).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == size).select(*NAMES, (F.lit(FULL) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    items = cut.where(F.col("length") < size)
    groups = max(1, -(-items.count() // group))

    def place(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")]
        table = table.sort_by(order)
        window, offset = best_fit(table["length"].to_pylist(), size)
        first = table["group"][0].as_py() << 32
        out = table.select(NAMES).append_column("sequence_id", pa.array(np.array(window, np.int64) + first))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    dealt = items.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(place, _schema(docs) + ", sequence_id bigint, offset bigint")
    return packed.unionByName(full)
