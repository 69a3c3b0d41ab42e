"""Facts from Python sources: one parse a file gives all of them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import KEY

FACTS = "kind string, name string, module string, level int, aliases array<string>, line int, end_line int, has_docstring boolean, value string, error string"
_FIELDS = [f.split()[0] for f in FACTS.split(", ")]
_TOLD = (ast.Import, ast.ImportFrom, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Call, ast.Assign)


def facts_of(source: str | None) -> Iterator[dict]:
    """Rows of kind module, import, from, class, function, call, assign or error; a file that does not parse gives its error."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield {"kind": "error", "error": type(e).__name__}
        return
    yield {"kind": "module", "line": 1, "has_docstring": ast.get_docstring(tree) is not None}
    for node in ast.walk(tree):
        if not isinstance(node, _TOLD):
            continue
        where = {"line": node.lineno, "end_line": node.end_lineno}
        match node:
            case ast.Import():
                yield {"kind": "import", "level": 0, "aliases": [a.name for a in node.names], **where}
            case ast.ImportFrom():
                yield {"kind": "from", "module": node.module, "level": node.level, "aliases": [a.name for a in node.names], **where}
            case ast.ClassDef():
                yield {"kind": "class", "name": node.name, **where}
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                yield {"kind": "function", "name": node.name, **where}
            case ast.Call(func=ast.Name()):
                yield {"kind": "call", "name": node.func.id, **where}
            case ast.Assign(value=ast.Constant(value=str())):
                for target in node.targets:
                    if isinstance(target, ast.Name):
                        yield {"kind": "assign", "name": target.id, "value": node.value.value, **where}
            case _:
                pass


SCHEMA = pa.schema([
    ("kind", pa.string()), ("name", pa.string()), ("module", pa.string()), ("level", pa.int32()), ("aliases", pa.list_(pa.string())), ("line", pa.int32()), ("end_line", pa.int32()),
    ("has_docstring", pa.bool_()), ("value", pa.string()), ("error", pa.string()),
])
ROWS = 10_000  # facts of one batch, more if a single file has more


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of all files, those of many small files in one batch."""
    for batch in batches:
        found, owners = [], []
        for i, source in enumerate(batch.column(2)):
            rows = list(facts_of(source.as_py()))
            found += rows
            owners += [i] * len(rows)
            if found and (len(found) >= ROWS or i + 1 == batch.num_rows):
                at = pa.array(owners, pa.int64())
                columns = [pa.array([r.get(f.name) for r in found], f.type) for f in SCHEMA]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], [KEY, "file", *_FIELDS])
                found, owners = [], []


def facts(files: DataFrame) -> DataFrame:
    """(repo_id, file, facts...) of (repo_id, path, content) rows; parsing happens once and in Arrow batches.

    Files are dealt over the cluster first: parsing is far dearer than reading, so that a table of
    few megabytes, a partition or two as it is read, is work for all cores.
    """
    kind = files.schema[KEY].dataType.simpleString()
    dealt = files.select(KEY, "path", "content").repartition(KEY, "path")
    return dealt.mapInArrow(_batches, f"{KEY} {kind}, file string, {FACTS}")


def structure(found: DataFrame) -> DataFrame:
    """(repo_id, file, imports, functions, classes), sorted and distinct; files with errors are left out."""
    named = F.when(F.col("kind") == "import", F.col("aliases")).when((F.col("kind") == "from") & F.col("module").isNotNull(), F.array("module"))
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    grouped = found.groupBy(KEY, "file").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(named)))).alias("imports"), of("function").alias("functions"), of("class").alias("classes"), F.bool_or(F.col("kind") == "error").alias("bad")
    )
    return grouped.where("not bad").drop("bad")


def imports(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind").isin("import", "from")).select(KEY, F.col("file").alias("source"), "kind", "module", "level", "aliases")


def symbols(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind").isin("class", "function")).select(KEY, "file", "kind", "name", F.col("line").alias("start_line"), "end_line")


def calls(found: DataFrame) -> DataFrame:
    return found.where("kind = 'call'").select(KEY, "file", "line", F.col("name").alias("function"))


def assignments(found: DataFrame) -> DataFrame:
    return found.where("kind = 'assign'").select(KEY, "file", "line", "name", "value")


def documentation(found: DataFrame) -> DataFrame:
    from strata.functions import paths

    return found.where("kind = 'module'").select(KEY, "file", paths.module_name(F.col("file")).alias("module_name"), "has_docstring")
