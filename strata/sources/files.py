"""Files of repositories: scans, counts, trees, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import paths
from strata.operators.graph import KEY
from strata.sources import repository

SNAPSHOT_SCHEMA = """
metadata struct<repository_name:string,repository_path:string,total_files:bigint,python_files:bigint>,
production_modules array<struct<file:string,module_name:string,type:string,layer:string,outgoing_dependencies:array<string>,incoming_dependencies:array<string>,outgoing_count:bigint,incoming_count:bigint,total_connections:bigint>>,
layers array<struct<file:string,layer:string>>, layer_summary map<string,bigint>, layer_percentages map<string,double>,
graph struct<nodes:array<struct<id:string,label:string,type:string>>,edges:array<struct<source:string,target:string>>>,
graph_summary struct<node_count:bigint,edge_count:bigint,isolated_node_count:bigint,isolated_nodes:array<string>,top_connected_nodes:array<string>>
"""


def bare(name: Column) -> Column:
    """A file's name without scheme and authority."""
    return F.regexp_replace(name, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(?=/)", "")


def scan(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(repo_id, path, content, size): every file below ``root``; content of relevant files that are UTF-8, else null."""
    return repository.read(spark, root, repo_id=repo_id).select(KEY, "path", "content", "size")


def relevant(files: DataFrame) -> DataFrame:
    return files.where(paths.is_relevant(F.col("path")))


def metadata(files: DataFrame) -> DataFrame:
    """(repo_id, total_files, python_files) of all files, those below .git included."""
    return files.groupBy(KEY).agg(F.count("*").alias("total_files"), F.count_if(paths.suffix(F.col("path")) == ".py").alias("python_files"))


def tree(files: DataFrame) -> DataFrame:
    """(repo_id, path, parent, name, is_dir, depth): each directory and file once, .git left out."""
    p = paths.parts(F.col("path"))
    clear = files.where(~F.array_contains(p, ".git")).select(KEY, p.alias("p"))
    prefixes = clear.select(KEY, "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    node = lambda n: F.array_join(F.slice("p", 1, n), "/")
    rows = prefixes.select(KEY, node(F.col("n")).alias("path"), node(F.col("n") - 1).alias("parent"), F.col("p")[F.col("n") - 1].alias("name"), (F.col("n") < F.size("p")).alias("is_dir"), F.col("n").cast("bigint").alias("depth"))
    return rows.groupBy(KEY, "path", "parent", "name", "depth").agg(F.bool_or("is_dir").alias("is_dir"))


def printed_tree(nodes: DataFrame) -> DataFrame:
    """Lines of a tree: two spaces a level, directories before files, names in any case."""
    return nodes.select(KEY, "parent", "is_dir", "name", F.concat(F.repeat(F.lit(" "), (2 * (F.col("depth") - 1)).cast("int")), F.col("name")).alias("line")).orderBy(
        KEY, "parent", F.desc("is_dir"), F.lower("name")
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_snapshot(snapshot: DataFrame, directory: str, stamp: str) -> str:
    """Append a snapshot under a name with its time; older ones stay."""
    path = f"{directory.rstrip('/')}/snapshot_{stamp}.json"
    snapshot.coalesce(1).write.mode("errorifexists").json(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row with the snapshot's parts; a missing path raises."""
    return spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(path)


def modules_by_path(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Modules of many snapshots in one scan, with ``snapshot``, the path of each as ``bare`` gives it."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(paths)
    # A snapshot is a file, or a folder of part files.
    at = F.regexp_replace(bare(F.url_decode(F.col("_metadata.file_path"))), r"/part-[^/]*$", "")
    return rows.select(at.alias("snapshot"), F.posexplode("production_modules").alias("pos", "m")).select("snapshot", "pos", "m.*")


def snapshot_modules(snapshot: DataFrame, repo_id: str) -> DataFrame:
    rows = snapshot.select(F.posexplode("production_modules").alias("pos", "m"))
    return rows.select(F.lit(repo_id).alias(KEY), "pos", "m.*")
