"""Stored artifacts of an analysis: one JSON object, or a list of JSON rows, with a check of which it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNKS = """
file string, extension string, start_line bigint, end_line bigint, content string,
symbols struct<classes:array<struct<name:string,start_line:bigint,end_line:bigint>>,functions:array<struct<name:string,start_line:bigint,end_line:bigint>>>
"""
ANALYSIS = """
metadata struct<repository_name:string,repository_path:string,total_files:bigint,python_files:bigint>, relevant_files array<string>,
dependency_graph struct<edges:array<struct<source:string,target:string,import:string>>,summary:struct<total_edges:bigint,files_with_dependencies:bigint,files_depended_on:bigint>>,
architecture struct<production_modules:array<struct<file:string,module_name:string,type:string,layer:string,outgoing_dependencies:array<string>,incoming_dependencies:array<string>,outgoing_count:bigint,incoming_count:bigint,total_connections:bigint>>,
graph_summary:struct<node_count:bigint,edge_count:bigint,isolated_node_count:bigint,isolated_nodes:array<string>,top_connected_nodes:array<string>>,layer_summary:map<string,bigint>,layer_percentages:map<string,double>>,
risks struct<risk_signals:array<struct<category:string,signal:string,severity:string,status:string,file:string,module_name:string>>,risk_signal_count:bigint>
"""
STRUCTURE = "file string, imports array<string>, functions array<string>, classes array<string>"


def root_kind(spark: SparkSession, path: str) -> str:
    """object, list or other: what the JSON at a path begins with; a missing path raises."""
    heads = spark.read.text(path, wholetext=True).select(F.left(F.ltrim(F.regexp_replace("value", r"^\s+", "")), F.lit(1)).alias("h")).distinct()
    found = {r.h for r in heads.limit(3).collect()}
    return {"{": "object", "[": "list"}.get(found.pop(), "other") if len(found) == 1 else "other"


def save_object(row: DataFrame, path: str) -> None:
    """One row as one JSON object."""
    row.coalesce(1).write.mode("overwrite").json(path)


def save_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in as many files as there are partitions; text beyond ASCII stays as it is."""
    rows.write.mode("overwrite").json(path)


def load_object(spark: SparkSession, path: str, schema: str | StructType = ANALYSIS) -> DataFrame:
    """The one object at a path; anything else raises."""
    if root_kind(spark, path) != "object":
        raise ValueError(f"{path} must hold a JSON object")
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    if found.limit(2).count() != 1:
        raise ValueError(f"{path} must hold one JSON object")
    return found


def load_rows(spark: SparkSession, path: str, schema: str | StructType = CHUNKS) -> DataFrame:
    """The rows at a path, a JSON list or the lines that ``save_rows`` wrote; a lone document raises."""
    kind = root_kind(spark, path)
    if kind == "list":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    first = next(iter((schema if isinstance(schema, StructType) else lines.schema).fieldNames()))
    if kind != "object" or lines.where(F.col(first).isNull()).limit(1).count():
        raise ValueError(f"{path} must hold a list of JSON rows")
    return lines
