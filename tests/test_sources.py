"""The repository data source, the parser in SQL, and committed versions."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from strata.functions import paths
from strata.sources import files, repository, udtf, versions

FILES = {
    "a.py": "import os\n", "docs/x.md": "hi", "docs/deep/er/y.PY": "z = 1\n", ".git/config": "c", ".hidden": "", "_under.py": "", "venv/b.py": "x", "bad.py": "é", "empty.txt": "", "src/a.tar.gz": "gz", "src/..py": "dots", "src/n.": "end",
}


@pytest.fixture
def root(tmp_path):
    for name, content in FILES.items():
        at = tmp_path / "repo" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    (tmp_path / "repo" / "latin.txt").write_bytes(b"\xff\xfe")
    return tmp_path / "repo"


@pytest.mark.parametrize("slots", ["1", "3"])
def test_every_file_is_a_row(spark, root, slots):
    found = {r.path: r for r in repository.read(spark, str(root), slots=slots).collect()}
    assert set(found) == {*FILES, "latin.txt"} and {r.repo_id for r in found.values()} == {"repo"}
    assert all(found[p].size == os.path.getsize(root / p) for p in found)
    known = spark.createDataFrame([(p,) for p in found], "path string").select("path", paths.suffix(F.col("path")).alias("suffix"), paths.is_relevant(F.col("path")).alias("relevant")).collect()
    for r in known:
        assert (found[r.path].suffix, repository.is_relevant(r.path)) == (r.suffix, r.relevant), r.path
        assert found[r.path].content == (FILES.get(r.path) if r.relevant else None)


def test_filters_reach_the_source(spark, root, monkeypatch):
    df = repository.read(spark, str(root)).where("suffix in ('.py', '.md') and path like '%x.md'")
    assert [r.path for r in df.collect()] == ["docs/x.md"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan
    assert {r.path for r in repository.read(spark, str(root)).where("suffix = '.py'").collect()} == {"a.py", "docs/deep/er/y.PY", "_under.py", "venv/b.py", "bad.py"}
    assert all(r.content is None for r in repository.read(spark, str(root), content="false").collect())


def test_many_repositories(spark, tmp_path, root):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "m.py").write_text("pass")
    found = {(r.repo_id, r.path) for r in repository.read(spark, str(tmp_path), repositories="true").collect()}
    assert found == {("other", "m.py"), *(("repo", p) for p in (*FILES, "latin.txt"))}


def test_partitions_are_folders(root):
    reader = repository.RepositoryReader(str(root), {})
    assert sorted((p.folder.rsplit("/", 1)[-1], p.deep) for p in reader.partitions()) == [(".git", True), ("docs", True), ("repo", False), ("src", True), ("venv", True)]
    assert len(repository.RepositoryReader(str(root), {"slots": "4"}).partitions()) == 1 + 4 * 4


def test_scan_is_the_source(spark, root):
    assert sorted(tuple(r) for r in files.scan(spark, str(root), "r").collect()) == sorted(("r", r.path, r.content, r.size) for r in repository.read(spark, str(root)).collect())


def test_parser_in_sql(spark):
    sources = spark.createDataFrame([("a", "import os, re\nclass C:\n    def f(self): pass\n"), ("b", "def broken(:"), ("c", None)], "path string, content string")
    udtf.register(spark)
    rows = spark.sql("SELECT path, f.kind, f.name, f.line, f.aliases FROM {sources}, LATERAL python_facts(content) f", sources=sources).collect()
    assert {(r.path, r.kind, r.name, r.line) for r in rows} == {("a", "module", None, 1), ("a", "import", None, 1), ("a", "class", "C", 2), ("a", "function", "f", 3), ("b", "error", None, None), ("c", "module", None, 1)}
    assert next(r.aliases for r in rows if r.kind == "import") == ["os", "re"]


def test_versions(spark, tmp_path):
    at = str(tmp_path / "versions")
    rows = lambda *vs: spark.createDataFrame([(r, f, n) for r, f, n in vs], "repo_id string, file string, n int")
    first = rows(("01", "a.py", 1), ("01", "b.py", 2), ("x y", "c.py", 3))
    versions.write(first, at, "20260101_000000")
    versions.write(rows(("01", "a.py", 10)), at, "20260102_000000")
    assert {(r.repo_id, r.snapshot_ts, r.rows) for r in versions.manifests(spark, at).collect()} == {("01", "20260101_000000", 2), ("x y", "20260101_000000", 1), ("01", "20260102_000000", 1)}
    newest = versions.read(spark, at, first.schema, versions.newest(spark, at))
    assert {(r.repo_id, r.file, r.n, r.snapshot_ts) for r in newest.collect()} == {("01", "a.py", 10, "20260102_000000"), ("x y", "c.py", 3, "20260101_000000")}
    before = versions.read(spark, at, first.schema, versions.newest(spark, at, 2))
    assert {(r.repo_id, r.file) for r in before.collect()} == {("01", "a.py"), ("01", "b.py")}


def test_a_failed_writer_leaves_nothing_to_see(spark, tmp_path):
    at = str(tmp_path / "versions")
    good = spark.createDataFrame([("r", "a.py", 1)], "repo_id string, file string, n int")
    versions.write(good, at, "20260101_000000")
    with pytest.raises(Exception, match="(?i)division|divide"):
        versions.write(spark.range(8).select(F.lit("r").alias("repo_id"), F.lit("b.py").alias("file"), F.expr("cast(1 / (7 - id) as int)").alias("n")), at, "20260102_000000")
    # Rows whose manifest never came.
    good.withColumn("snapshot_ts", F.lit("20260103_000000")).write.partitionBy("repo_id", "snapshot_ts").parquet(f"{at}/data/commit=lost")
    assert versions.manifests(spark, at).count() == 1
    assert [r.snapshot_ts for r in versions.read(spark, at, good.schema, versions.newest(spark, at)).collect()] == ["20260101_000000"]
