"""A table of questions against asking them one by one."""

from __future__ import annotations

import zlib

from tests.test_facade import TREE

from strata.operators import index
from strata.plans import facade, many, qa

QUESTIONS = [
    "How many Python files are there?", "What does app.session depend on?", "Show me the passwords", "Who is the author of this repository?", "How does the Session class send a request?",
    "Explain the architecture of the dependency graph", "send", "Which module imports adapter?", "zebra quagga okapi", "What is the layer structure of session and adapter modules?",
]


def spoken(prompt):
    """Replies that depend on the prompt alone: answers of two claims, unknowns, and decisions."""
    n = zlib.crc32(prompt.encode())
    if prompt.startswith("Answer only"):
        return ["UNKNOWN", "The Session class sends a request through the adapter. app.session has 2 outgoing dependencies.", '{"answer": "The adapter evaluates a request. Nothing else is known."}'][n % 3]
    return ["supported", "no", '{"decision": "partially_supported"}', "unsupported"][n % 4]


def test_as_one_by_one(spark):
    files = spark.createDataFrame([(r, p, c, len(c)) for r in ("r", "other") for p, c in TREE.items() if r == "r" or p != "src/app/adapter.py"], "repo_id string, path string, content string, size long")
    a = facade.Analysis(files, 3)
    counts = a.overview()
    rows = [(i, r, q) for i, (r, q) in enumerate((r, q) for r in ("r", "other") for q in QUESTIONS)]
    asked = spark.createDataFrame(rows, "question int, repo_id string, query string")
    found = {r.question: r for r in many.answer_many(asked, index.build(a.chunks, scoped=True), a.chunks, counts, a.modules, a.module_edges, lambda p: qa.provider_column(p, spoken)).collect()}
    assert len(found) == len(rows)
    assert {found[i].answer for i, _, q in rows if "passwords" in q or "author" in q or "zebra" in q} == {"UNKNOWN"}
    for i, repo, query in rows[:10]:
        one = a.ask(query, repo, spoken)
        got = found[i]
        assert (got.answer, got.status) == (one.answer, one.status), query
        assert (got.claim_count, got.supported_claims, got.coverage) == tuple(one.coverage[c] for c in ("claim_count", "supported_claims", "coverage")), query
    assert len({r.status for r in found.values()}) > 1 and {r.origin for r in found.values()} >= {"provider", "metadata", "sensitive"}
