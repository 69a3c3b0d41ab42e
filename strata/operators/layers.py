"""Layer tables and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import paths
from strata.operators.graph import KEY


def classify(files: DataFrame) -> DataFrame:
    """(repo_id, file, layer) of all paths outside .git."""
    kept = files.where(~F.array_contains(paths.parts(F.col("path")), ".git"))
    return kept.select(KEY, F.col("path").alias("file"), paths.layer(F.col("path")).alias("layer"))


def summary(layers: DataFrame) -> DataFrame:
    return layers.groupBy(KEY, "layer").agg(F.count("*").alias("files"))


def percentages(layers: DataFrame) -> DataFrame:
    """Share of each layer in percent, two places."""
    counts = summary(layers)
    totals = counts.groupBy(KEY).agg(F.sum("files").alias("all_files"))
    return counts.join(totals, KEY).select(KEY, "layer", F.round(100.0 * F.col("files") / F.col("all_files"), 2).alias("percentage"))
