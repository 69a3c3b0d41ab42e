"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
again, so that a lost executor costs a re-read and never the rows themselves.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate files, one per application.

    Read from ``spark.checkpoint.dir``.  Only a local master may go without that
    setting and then gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strata-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised within goes when the block ends; results must be written elsewhere by then."""
    mark = len(_written)
    try:
        yield
    finally:
        own, _written[mark:] = _written[mark:], []
        for _, path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone
            return
