"""Plans: scans read what they need, filters reach them, Python stays out of core queries."""

from __future__ import annotations

import re

import pytest

from strata.queries import answers, prose, qa, structure

PYTHON = {"mmr_top_k", "python_structure", "structure_totals", "chunk_symbols", "rate_limiter", "scc_cycles", "circular_claims", "score_symbols", "parsed_imports"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [("layer_summary", {"doc_id", "lang", "source"}), ("tokenize_documents", {"doc_id", "text"}), ("snapshot_pair", {"o_custkey", "o_orderdate"}), ("windowed_requests", {"ts", "user_id"}), ("url_projection", {"url"})],
)
def test_scans_read_only_what_is_used(spark, small, name, columns):
    query = {**structure.QUERIES, **prose.QUERIES}[name]
    found = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(query(spark, small))) for c in s.split(",") if c}
    assert found and found <= columns


def test_filters_reach_the_scan(spark, small):
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in plan_of(prose.decompose_claims(spark, small))


@pytest.mark.parametrize("name", sorted({**structure.QUERIES, **prose.QUERIES, **qa.QUERIES, **answers.QUERIES}.keys() - PYTHON))
def test_no_python_in_core_plans(spark, small, name):
    plan = plan_of({**structure.QUERIES, **prose.QUERIES, **qa.QUERIES, **answers.QUERIES}[name](spark, small))
    assert not re.search("EvalPython|InPandas|InArrow", plan)
    assert "CartesianProduct" not in plan


def test_claims_are_split_without_a_shuffle(spark, small):
    assert "Exchange" not in plan_of(prose.decompose_claims(spark, small))


def test_top_k_moves_only_the_best_rows(spark, small):
    assert "TakeOrderedAndProject" in plan_of(prose.retrieve_filtered(spark, small))


@pytest.mark.parametrize("name", ["fact_answers", "graph_summary", "risk_report", "drift_summary", "module_ranking", "verify_claims", "repository_overview"])
def test_plans_stay_small(spark, small, name):
    plan = plan_of({**structure.QUERIES, **qa.QUERIES, **answers.QUERIES}[name](spark, small))
    assert plan.count("Exchange ") <= 30
    assert len(re.findall(r"lineitem\.parquet", plan)) <= 1


@pytest.mark.parametrize("name", ["fact_answers", "module_answers", "verify_claims", "verify_numeric_claims"])
def test_generated_code_is_not_outgrown(spark, small, name):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert {**prose.QUERIES, **qa.QUERIES, **answers.QUERIES}[name](spark, small).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
