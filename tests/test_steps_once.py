"""Texts are scored once and only where they can count; facts of a source are rows, not a table each."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.functions import text
from strata.operators import evidence
from strata.sources import udtf

QUERIES = ["idiot clown", "queries of the session", "utility classes", "authentication", "a_b buses", "parse"]
CONTENTS = ["IdiotBox", "clowns", "query", "queries", "sessions_x", "SESSION", "util", "utilities", "class", "auth", "Authenticate", "bus", "buse", "bu", "parses parsed", "pars", "nothing", "", None, "a_b", "HTTPIdiot_s"]


@pytest.mark.parametrize("query", QUERIES)
def test_chunks_passed_over_share_nothing(spark, query):
    chunks = spark.createDataFrame([(f"lib/{'clown' if i % 7 == 0 else 'x'}{i}.py", i, c, "", i) for i, c in enumerate(CONTENTS)], "file string, start_line int, content string, symbol_names string, pos int")
    asked = text.selector_forms(text.selector_tokens(F.lit(query)))
    score = evidence.context_score(asked, F.col("content"), F.col("file"), F.col("symbol_names"))[3]
    fit = {r.pos for r in chunks.where(score > 0).collect()}
    possible = {r.pos for r in evidence._possible(chunks, evidence._asked_forms(spark, query)).collect()}
    assert fit <= possible and 16 not in possible - {p for p in possible if p % 7 == 0}


def test_texts_are_scored_once(spark):
    chunks = spark.createDataFrame([("a.py", 1, "clown", "", 1)], "file string, start_line int, content string, symbol_names string, pos int")
    plan = evidence.diverse_code(chunks, "clown")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "ExistingRDD" not in plan and "regexp" not in plan


def test_facts_of_a_source_are_no_table_each(spark):
    udtf.register(spark)
    found = spark.sql("SELECT f.kind FROM VALUES ('import a'), ('from b import c') s(content), LATERAL python_facts(s.content) f")
    assert "ArrowEvalPythonUDTF" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.kind for r in found.collect()) == ["from", "import", "module", "module"]
