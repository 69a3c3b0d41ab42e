"""Parsing of many small files: over all cores, in few batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.sources import pyast


def test_files_are_dealt_before_they_are_parsed(spark):
    rows = spark.range(400).coalesce(1).select(F.lit("r").alias("repo_id"), F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("import os\nclass C"), "id", F.lit(": pass\n")).alias("content"))
    found = pyast.facts(rows.coalesce(1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    assert found.groupBy("kind").count().orderBy("kind").collect() == [("class", 400), ("import", 400), ("module", 400)]


def test_small_files_share_a_batch(monkeypatch):
    import pyarrow as pa

    def run():
        batch = pa.RecordBatch.from_pydict({"repo_id": ["r"] * 9, "path": [f"m{i}" for i in range(9)], "content": ["import a\nx = 'b'", None, "def broken(:"] * 3})
        return list(pyast._batches(iter([batch, batch.slice(0, 0), batch])))

    whole = run()
    assert len(whole) == 2
    monkeypatch.setattr(pyast, "ROWS", 4)
    cut = run()
    assert len(cut) > 2 and pa.Table.from_batches(cut) == pa.Table.from_batches(whole)
    assert [(r["file"], r["kind"]) for r in whole[0].to_pylist()[:6]] == [("m0", "module"), ("m0", "import"), ("m0", "assign"), ("m1", "module"), ("m2", "error"), ("m3", "module")]
