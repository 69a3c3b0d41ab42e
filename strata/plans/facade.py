"""The service's questions as functions over stored artifacts: overview, analysis, drift, ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strata.operators import drift, evidence, graph, layers, retrieval, risk
from strata.operators.graph import KEY
from strata.plans import qa
from strata.sources import files as source_files
from strata.sources import pyast
from strata.storage import materialize


class Analysis:
    """All relations of the repositories in a table of files, each derived once from one parse.

    ``drift`` has (repo_id, file, change) between the two newest snapshots, as ``module_drift`` gives
    it: removed modules are risks too.
    """

    def __init__(self, files: DataFrame, chunk_lines: int = 50, drift: DataFrame | None = None):
        self.files = files
        self.facts = materialize(pyast.facts(source_files.relevant(files).where(F.col("path").endswith(".py"))), "facts")
        self.structure = pyast.structure(self.facts)
        self.edges = materialize(graph.resolve(graph.imported_names(pyast.imports(self.facts)), graph.module_map(files)), "edges")
        self.production = graph.production_files(files)
        self.layers = layers.classify(files)
        self.modules = materialize(graph.modules(self.production, graph.production_pairs(self.edges, self.production)), "modules")
        self.module_edges = graph.graph_edges(self.modules)
        symbols = pyast.symbols(self.facts)
        self.chunks = retrieval.attach_symbols(retrieval.chunks(source_files.relevant(files).select(KEY, "path", "content"), chunk_lines), symbols)
        pairs = self.edges.select(KEY, "source", "target")
        found = [
            risk.hotspots(self.modules), risk.circular_dependencies(pairs), risk.layer_violations(self.edges, self.layers),
            risk.missing_test_counterparts(self.production, files), risk.hardcoded_secrets(pyast.assignments(self.facts)), risk.dynamic_execution(pyast.calls(self.facts)),
        ]
        found += [risk.removed_modules(drift)] if drift is not None else []
        self.signals = risk.normalise(risk.union_signals(*found))

    def overview(self) -> DataFrame:
        return evidence.overview(self.files, self.edges, self.modules, self.module_edges, self.signals)

    def snapshot(self) -> DataFrame:
        """One row a repository in the snapshot's shape."""
        row = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
        mods = self.modules.groupBy(KEY).agg(row("file", "module_name", "type", "layer", "outgoing_dependencies", "incoming_dependencies", "outgoing_count", "incoming_count", "total_connections").alias("production_modules"))
        lays = self.layers.groupBy(KEY).agg(row("file", "layer").alias("layers"))
        return lays.join(mods, KEY, "left")

    def ask(self, query: str, repo_id: str, provider: qa.Provider, k: int = 5) -> qa.Answer:
        return qa.ask(query, repo_id, self.chunks.where(F.col(KEY) == repo_id), self.overview(), self.modules, self.module_edges, provider, k)


def load_snapshot(spark: SparkSession, *candidates: str | None) -> DataFrame | None:
    """The first candidate that is there: canonical, newest version, then the analysis itself."""
    for path in candidates:
        if path is None:
            continue
        try:
            found = source_files.read_snapshot(spark, path)
            if found.where(F.col("production_modules").isNotNull()).limit(1).count():
                return found
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None


def _paired_modules(spark: SparkSession, pairs: DataFrame) -> DataFrame | None:
    """Modules of both snapshots of each pair, ``was`` telling which; None without pairs."""
    named = pairs.where("baseline is not null").select(KEY, F.explode(F.array(F.struct(F.col("baseline").alias("path"), F.lit(True).alias("was")), F.struct(F.col("current").alias("path"), F.lit(False).alias("was")))).alias("s"))
    paths = sorted({r.path for r in named.select("s.path").distinct().collect()})
    if not paths:
        return None
    modules = source_files.modules_by_path(spark, paths)
    return materialize(named.select(KEY, "s.was", source_files.bare(F.col("s.path")).alias("snapshot")).join(modules, "snapshot").drop("snapshot"), "snapshot-modules")


def module_drift(spark: SparkSession, snapshots: DataFrame) -> DataFrame:
    """(repo_id, file, change) between the two newest of (repo_id, path) snapshots of each repository; no rows where there is only one."""
    joined = _paired_modules(spark, materialize(drift.pair(snapshots), "snapshot-pairs"))
    if joined is None:
        return snapshots.select(KEY, F.lit("").alias("file"), F.lit("").alias("change")).limit(0)
    return drift.module_drift(joined.where("was"), joined.where("not was"))


def drift_report(spark: SparkSession, snapshots: DataFrame) -> DataFrame:
    """Drift of the newest snapshot against the one before, by repository; unconfigured where there is only one.

    ``snapshots`` has repo_id and path.  All snapshots that a pair names are read
    in one scan and find their repository by path; of them only paths come to
    the driver, which plans the scan.
    """
    pairs = materialize(drift.pair(snapshots), "snapshot-pairs")
    lone = pairs.where("baseline is null").select(KEY, F.lit("unconfigured").alias("status"))
    joined = _paired_modules(spark, pairs)
    if joined is None:
        return lone
    whole = drift.report(joined.where("was").drop("was"), joined.where("not was").drop("was"))
    return whole.unionByName(lone, allowMissingColumns=True)
