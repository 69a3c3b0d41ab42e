"""Versions of repositories' relations in partitioned tables that readers see whole or not at all.

A writer puts its rows under a commit of its own, by repository and time, and only then
a manifest that names what the commit holds.  Readers go by manifests: what a failed writer has
left behind has none.  Nothing is gathered in one task, and the newest version
is found from manifests alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from strata.operators.graph import KEY

MANIFEST = f"commit string, {KEY} string, snapshot_ts string, rows bigint"
PLACE = ["commit", KEY, "snapshot_ts"]


def write(rows: DataFrame, directory: str, stamp: str) -> str:
    """Writes ``rows`` (with repo_id) as the version of that time; the commit's name."""
    commit = uuid.uuid4().hex
    target = f"{directory}/data/commit={commit}"
    placed = rows.withColumn("snapshot_ts", F.lit(stamp))
    placed.write.partitionBy(KEY, "snapshot_ts").parquet(target)
    written = rows.sparkSession.read.schema(_with_place(rows.schema)).option("basePath", f"{directory}/data").parquet(target)
    written.groupBy(*PLACE).agg(F.count("*").alias("rows")).write.json(f"{directory}/manifests/{commit}")
    return commit


def _with_place(schema: StructType) -> StructType:
    out = StructType([f for f in schema.fields if f.name not in PLACE])
    for name in PLACE:
        out = out.add(name, StringType())
    return out


def manifests(spark: SparkSession, directory: str) -> DataFrame:
    """(commit, repo_id, snapshot_ts, rows) of all whole versions."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{directory}/manifests")


def newest(spark: SparkSession, directory: str, age: int = 1) -> DataFrame:
    """Manifest rows of each repository's newest version, or the one ``age`` - 1 before; of one time the last commit name counts."""
    one = manifests(spark, directory).groupBy(KEY, "snapshot_ts").agg(F.max("commit").alias("commit"))
    order = Window.partitionBy(KEY).orderBy(F.desc("snapshot_ts"))
    return one.withColumn("age", F.row_number().over(order)).where(F.col("age") == age).select(*PLACE)


def read(spark: SparkSession, directory: str, schema: StructType, which: DataFrame) -> DataFrame:
    """Rows of the versions that ``which`` names; only their partitions are read."""
    every = spark.read.schema(_with_place(schema)).parquet(f"{directory}/data")
    return every.join(which.select(*PLACE), PLACE, "left_semi").drop("commit")
