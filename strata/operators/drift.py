"""Drift between two snapshots: modules, their dependencies, their layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import paths
from strata.operators.graph import KEY


def newest(snapshots: DataFrame, n: int = 2) -> DataFrame:
    """The n newest of (repo_id, path) by the time in the name, then by name; names without a time come first."""
    order = Window.partitionBy(KEY).orderBy(F.desc_nulls_last("snapshot_ts"), F.desc("name"))
    timed = snapshots.select(KEY, "path", paths.snapshot_time(F.col("path")).alias("snapshot_ts"), paths.file_name(F.col("path")).alias("name"))
    return timed.withColumn("age", F.row_number().over(order).cast("bigint")).where(F.col("age") <= n).drop("name")


def pair(snapshots: DataFrame) -> DataFrame:
    """(repo_id, baseline, current); both null unless there are two snapshots."""
    two = newest(snapshots).groupBy(KEY).agg(F.max(F.when(F.col("age") == 2, F.col("path"))).alias("baseline"), F.max(F.when(F.col("age") == 1, F.col("path"))).alias("current"))
    return two.select(KEY, "baseline", F.when(F.col("baseline").isNotNull(), F.col("current")).alias("current"))


def _one_each(modules: DataFrame) -> DataFrame:
    """One row a file: the last by position where there is one."""
    if "pos" not in modules.columns:
        return modules.dropDuplicates([KEY, "file"])
    rest = [c for c in modules.columns if c not in (KEY, "file", "pos")]
    last = modules.groupBy(KEY, "file").agg(F.max_by(F.struct(*rest), "pos").alias("m"))
    return last.select(KEY, "file", *(F.col("m")[c].alias(c) for c in rest))


def module_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(repo_id, file, change): added, removed or unchanged."""
    a = baseline.select(KEY, "file").distinct().withColumn("was", F.lit(True))
    b = current.select(KEY, "file").distinct().withColumn("now", F.lit(True))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("unchanged")
    return a.join(b, [KEY, "file"], "full_outer").select(KEY, "file", change.alias("change"))


def dependency_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Files in both snapshots whose outgoing dependencies differ, with what came and went."""
    none = F.array().cast("array<string>")
    a = _one_each(baseline).select(KEY, "file", F.coalesce("outgoing_dependencies", none).alias("was"))
    b = _one_each(current).select(KEY, "file", F.coalesce("outgoing_dependencies", none).alias("now"))
    both = a.join(b, [KEY, "file"])
    added, removed = F.array_sort(F.array_except("now", "was")), F.array_sort(F.array_except("was", "now"))
    return both.select(KEY, "file", added.alias("added"), removed.alias("removed")).where((F.size("added") > 0) | (F.size("removed") > 0))


def layer_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    a = _one_each(baseline).select(KEY, "file", F.col("layer").alias("baseline_layer"))
    b = _one_each(current).select(KEY, "file", F.col("layer").alias("current_layer"))
    return a.join(b, [KEY, "file"]).where(~F.col("baseline_layer").eqNullSafe(F.col("current_layer")))


def report(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row a repository: counts, has_drift and a sentence."""
    mods = module_drift(baseline, current).groupBy(KEY).agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "unchanged")))
    deps = dependency_drift(baseline, current).groupBy(KEY).agg(F.count("*").alias("changed_dependencies"))
    lays = layer_drift(baseline, current).groupBy(KEY).agg(F.count("*").alias("changed_layers"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = mods.join(deps, KEY, "left").join(lays, KEY, "left")
    out = out.select(KEY, "added", "removed", "unchanged", zero("changed_dependencies").alias("changed_dependencies"), zero("changed_layers").alias("changed_layers"))
    drifted = (F.col("added") + F.col("removed") + F.col("changed_dependencies") + F.col("changed_layers")) > 0
    changed = F.col("added") + F.col("removed")
    say = lambda n: F.concat(n.cast("string"), F.when(n == 1, " module").otherwise(" modules"))
    sentence = F.concat(
        say(changed), F.lit(" changed ("), say(F.col("added")), F.lit(" added, "), say(F.col("removed")), F.lit(" removed), "),
        say(F.col("changed_dependencies")), F.lit(" have dependency changes, and "), say(F.col("changed_layers")), F.lit(" have layer changes."),
    )
    sentence = F.when(drifted, sentence).otherwise("No architecture drift detected.")
    return out.select("*", drifted.alias("has_drift"), sentence.alias("summary"), F.lit("ready").alias("status"))
