"""Snapshots as they arrive: each new version of a repository gives a drift report against the one before.

A version is a file ``<repository>/snapshot_<time>.json`` (or a folder of part files of that
name).  Each micro-batch writes, under its own number, the modules of the newest
version of each repository it has seen and the reports of its versions; both
are overwritten when a batch is run again, which then reads the same earlier batches, so
a replay changes nothing.  A batch counts once its marker stands; readers look at no other.

A version not newer than the last one seen of its repository takes no part.  Several
versions of a repository in one batch are compared one after the other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.functions import paths
from strata.operators import drift
from strata.operators.graph import KEY
from strata.sources.files import SNAPSHOT_SCHEMA, bare

MARK = "batch bigint"
VERSION = [KEY, "snapshot_ts", "name"]
_PAIR = "\x01"


def arriving(spark: SparkSession, directory: str, files_a_batch: int | None = None) -> DataFrame:
    """Stream of (repo_id, snapshot_ts, name, production_modules) of the snapshots that appear under ``directory``."""
    reader = spark.readStream.schema(SNAPSHOT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    rows = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(directory)
    at = F.regexp_replace(bare(F.url_decode(F.col("_metadata.file_path"))), r"/part-[^/]*$", "")
    rows = rows.select(at.alias("path"), "production_modules")
    named = F.element_at(F.split("path", "/"), -2).alias(KEY), paths.snapshot_time(F.col("path")).alias("snapshot_ts"), paths.file_name(F.col("path")).alias("name")
    return rows.select(*named, "production_modules")


def _marked(spark: SparkSession, home: str, before: int) -> list[int]:
    """Numbers of the committed batches before one; the marker table has a row for each."""
    try:
        return [r.batch for r in spark.read.schema(MARK).option("recursiveFileLookup", True).json(f"{home}/commits").where(F.col("batch") < before).select("batch").distinct().collect()]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def _of_batches(spark: SparkSession, home: str, kind: str, batches: list[int]) -> DataFrame | None:
    return spark.read.parquet(*(f"{home}/{kind}/batch-{b}" for b in sorted(batches))) if batches else None


def commit(batch: DataFrame, number: int, home: str) -> None:
    """One micro-batch: its repositories' newest modules and the reports of its versions, then its marker."""
    spark = batch.sparkSession
    batch.persist()  # several outputs; a lost block is read from the source again
    try:
        earlier = _of_batches(spark, home, "newest", _marked(spark, home, number))
        newest_first = Window.partitionBy(KEY).orderBy(F.desc_nulls_last("snapshot_ts"), F.desc("name"))
        rows = batch.where(F.col("production_modules").isNotNull())
        if earlier is not None:
            mine = earlier.join(rows.select(KEY).distinct(), KEY, "left_semi")
            last = mine.withColumn("age", F.row_number().over(newest_first)).where("age = 1").select(*VERSION, "production_modules", F.lit(True).alias("old"))
            rows = rows.select(*VERSION, "production_modules", F.lit(False).alias("old")).unionByName(last)
        else:
            rows = rows.select(*VERSION, "production_modules", F.lit(False).alias("old"))
        # From the last version on: what is older than it, or it again, takes no part.
        ordered = Window.partitionBy(KEY).orderBy(F.asc_nulls_first("snapshot_ts"), "name", F.desc("old"))
        from_last = F.max(F.when(F.col("old"), F.struct("snapshot_ts", "name"))).over(Window.partitionBy(KEY))
        rows = rows.withColumn("from", from_last).where(F.col("from").isNull() | F.col("old") | (F.struct("snapshot_ts", "name") > F.col("from")))
        rows = rows.withColumns({"before": F.lag("name").over(ordered), "was": F.lag("production_modules").over(ordered)})
        new = rows.where(~F.col("old"))
        pairs = new.where("before is not null").withColumn("pair", F.concat_ws(_PAIR, KEY, "before", "name"))
        side = lambda c: pairs.select(F.col("pair").alias(KEY), F.posexplode(c).alias("pos", "m")).select(KEY, "pos", "m.*")
        told = drift.report(side("was"), side("production_modules"))
        part = lambda i: F.split(F.col(KEY), _PAIR)[i]
        told = told.select(part(0).alias("repo"), part(1).alias("baseline"), part(2).alias("current"), *[c for c in told.columns if c != KEY]).withColumnRenamed("repo", KEY)
        told.write.mode("overwrite").parquet(f"{home}/reports/batch-{number}")
        latest = new.withColumn("age", F.row_number().over(newest_first)).where("age = 1").select(*VERSION, "production_modules")
        latest.write.mode("overwrite").parquet(f"{home}/newest/batch-{number}")
        spark.range(1).select(F.lit(number).cast("bigint").alias("batch")).coalesce(1).write.mode("overwrite").json(f"{home}/commits/batch-{number}")
    finally:
        batch.unpersist()


def follow(stream: DataFrame, home: str, **trigger) -> StreamingQuery:
    """Runs ``commit`` on each micro-batch of ``arriving``; ``home`` must be on storage that the whole cluster shares."""
    writer = stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").foreachBatch(lambda df, n: commit(df, n, home))
    return (writer.trigger(**trigger) if trigger else writer).start()


def reports(spark: SparkSession, home: str) -> DataFrame:
    """All reports of committed batches: repo_id, baseline, current and the columns of ``drift.report``."""
    found = _of_batches(spark, home, "reports", _marked(spark, home, 1 << 62))
    if found is None:
        raise ValueError(f"no batch has been committed under {home}")
    return found


def newest(spark: SparkSession, home: str) -> DataFrame:
    """The last version of each repository: repo_id, snapshot_ts, name and production_modules."""
    rows = _of_batches(spark, home, "newest", _marked(spark, home, 1 << 62))
    if rows is None:
        raise ValueError(f"no batch has been committed under {home}")
    order = Window.partitionBy(KEY).orderBy(F.desc_nulls_last("snapshot_ts"), F.desc("name"))
    return rows.withColumn("age", F.row_number().over(order)).where("age = 1").drop("age")
