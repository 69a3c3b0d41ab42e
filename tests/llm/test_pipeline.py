"""The stages on awkward documents, and against their operators one by one."""

from __future__ import annotations

import pytest

pytest.importorskip("strata.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import cases  # noqa: E402

from strata.llm import pii, quality_rules, simhash  # noqa: E402
from strata.storage import materialize  # noqa: E402


def test_stages(spark, tmp_path):
    docs = cases.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, str(tmp_path)), "test")
        seen.append((name, at))
    assert [n for n, _ in seen] == ["quality rules", "SimHash near-dedup", "PII", "mixing", "BPE"]
    assert all(df.columns == docs.columns for _, df in seen[:-1])
    kept = cases.as_rows(quality_rules.judge(docs).where("kept"), "doc_id")
    assert cases.as_rows(seen[0][1], "doc_id") == kept
    groups = simhash.near_duplicates(seen[0][1]).select("component_id").distinct()
    assert seen[1][1].count() == groups.count()
    assert cases.as_rows(seen[2][1], "doc_id", "text") == cases.as_rows(pii.redact(seen[1][1]), "doc_id", "text")
    assert cases.as_rows(seen[4][1], "doc_id", "text") == cases.as_rows(seen[3][1], "doc_id", "text")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert cases.as_rows(whole, "doc_id", "text", "n_tokens") == cases.as_rows(seen[4][1], "doc_id", "text", "n_tokens")


def test_stages_on_no_documents(spark, tmp_path):
    cases.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
