"""Operators on small fixtures with known results."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.functions import paths, text
from strata.operators import claims, drift, evidence, graph, layers, retrieval, risk
from strata.plans import qa
from strata.sources import files, pyast
from strata.streaming import admission


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def repo(spark, **contents):
    return spark.createDataFrame([("r", p, c, len(c)) for p, c in contents.items()], "repo_id string, path string, content string, size long")


def edges_of(spark, tree):
    f = spark.createDataFrame([("r", p, c) for p, c in tree.items()], "repo_id string, path string, content string")
    found = graph.resolve(graph.imported_names(pyast.imports(pyast.facts(f))), graph.module_map(f))
    return {(e.source, e.target) for e in found.collect()}


@pytest.mark.parametrize(
    ("tree", "expected"),
    [
        ({"pkg/__init__.py": "", "pkg/a.py": "from . import b", "pkg/b.py": "", "pkg/sub/a.py": "from . import b", "pkg/sub/b.py": ""}, {("pkg/a.py", "pkg/b.py"), ("pkg/sub/a.py", "pkg/sub/b.py")}),
        ({"pkg/b.py": "", "pkg/sub/a.py": "from .. import b"}, {("pkg/sub/a.py", "pkg/b.py")}),
        ({"src/app/service.py": "from . import models", "src/app/models.py": ""}, {("src/app/service.py", "src/app/models.py")}),
        ({"left/utils.py": "", "right/utils.py": "", "consumer.py": "import utils"}, set()),
        ({"pkg/__init__.py": "from . import b as beta", "pkg/a.py": "import pkg.b as beta", "pkg/b.py": ""}, {("pkg/__init__.py", "pkg/b.py"), ("pkg/a.py", "pkg/b.py")}),
        ({"broken.py": "def (", "a.py": "import broken"}, {("a.py", "broken.py")}),
    ],
)
def test_edges_of_source_trees(spark, tree, expected):
    assert edges_of(spark, tree) == expected


def modules_of(spark, pairs, names):
    prod = spark.createDataFrame([("r", n) for n in names], "repo_id string, file string")
    e = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo_id string, source string, target string")
    return graph.modules(prod, e)


def test_graph_summary(spark):
    m = modules_of(spark, [("a", "b"), ("c", "a")], "abcd")
    g = graph.graph_summary(graph.graph_nodes(m), graph.graph_edges(m)).first()
    assert (g.node_count, g.edge_count, g.isolated_nodes) == (4, 2, ["d"])
    assert g.top_connected_nodes == ["a", "b", "c", "d"]


def test_severity(spark):
    rows = spark.createDataFrame([(n,) for n in (8, 14, 15, 24, 25, 40)], "n int").select(risk.severity(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["medium", "medium", "high", "high", "critical", "critical"]


CYCLES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "y"), ("s", "s")]


@pytest.mark.parametrize("local", [200_000, 0])
def test_cycles_local_and_distributed(spark, local):
    e = spark.createDataFrame([("r", a, b) for a, b in CYCLES], "repo_id string, source string, target string")
    assert sorted(r.cycle for r in graph.cycles(e, local).collect()) == [["a", "b", "c"], ["d", "e"], ["s"]]


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    rows = [(f"r{rng.randint(0, 5)}", f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(350)]
    e = spark.createDataFrame(rows, "repo_id string, source string, target string")
    assert sorted(map(tuple, graph.components(e, 0).collect())) == sorted(map(tuple, graph.components(e).collect()))


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or write(df, name))
    e = spark.createDataFrame([("r", f"n{i:05d}", f"n{(i + 1) % 10000:05d}") for i in range(10000)], "repo_id string, source string, target string")
    assert [tuple(r) for r in graph.components(e, 0).groupBy("component").count().collect()] == [("n00000", 10000)]
    assert len(written) < 40


def test_cycles_of_nothing(spark):
    assert graph.cycles(spark.createDataFrame([], "repo_id string, source string, target string")).count() == 0


def test_layers(spark):
    names = {"tests/conftest.py": "test", "pkg/test_x.py": "test", "docs/a.py": "documentation", "README.md": "documentation", "setup.py": "configuration", "src/a.c": "source", "a.py": "source", "a.bin": "other", ".md": "other"}
    df = spark.createDataFrame([("r", p) for p in names], "repo_id string, path string")
    assert {r.file: r.layer for r in layers.classify(df).collect()} == names
    five = spark.createDataFrame([("r", f"f{i}", x) for i, x in enumerate(["source", "test", "documentation", "documentation", "other"])], "repo_id string, file string, layer string")
    assert {r.layer: r.percentage for r in layers.percentages(five).collect()} == {"source": 20.0, "test": 20.0, "documentation": 40.0, "other": 20.0}


def test_roles_and_names(spark):
    assert one(spark, paths.retrieval_role(F.col("p")), p="tests/conftest.py") == "neutral"
    assert one(spark, paths.retrieval_role(F.col("p")), p="test/a.py") == "test"
    assert one(spark, paths.module_name(F.col("p")), p="src/pkg/__init__.py") == "pkg"
    assert one(spark, paths.stem(F.col("p")), p="src/pkg/__init__.py") == "__init__"
    assert one(spark, paths.test_candidates(F.col("p")), p="src/app/api.py") == ["tests/test_api.py", "tests/test_app.py", "tests/test_app_api.py"]
    assert one(spark, paths.valid_clone_url(F.col("u")), u="https://github.com/a/b") is True
    assert one(spark, paths.valid_clone_url(F.col("u")), u="http://github.com/a/b") is False
    assert one(spark, paths.valid_clone_url(F.col("u")), u="https://github.com/a") is False


def snapshot(spark, rows):
    return spark.createDataFrame([("r", f, d, la) for f, (d, la) in rows.items()], "repo_id string, file string, outgoing_dependencies array<string>, layer string")


def test_drift(spark):
    a = snapshot(spark, {"auth": (["models"], "source"), "models": ([], "source"), "utils": (None, "source")})
    b = snapshot(spark, {"auth": (["models", "database"], "source"), "models": ([], "other"), "database": ([], None)})
    assert {r.file: r.change for r in drift.module_drift(a, b).collect()} == {"auth": "unchanged", "models": "unchanged", "utils": "removed", "database": "added"}
    (d,) = drift.dependency_drift(a, b).collect()
    assert (d.file, d.added, d.removed) == ("auth", ["database"], [])
    r = drift.report(a, b).first()
    assert r.summary == "2 modules changed (1 module added, 1 module removed), 1 module have dependency changes, and 1 module have layer changes."
    same = drift.report(a, a).first()
    assert (same.has_drift, same.summary) == (False, "No architecture drift detected.")


def test_snapshot_pair(spark):
    rows = [("r", "s/snapshot_20260101_000000.json"), ("r", "s/zzz.json"), ("r", "s/snapshot_20270101_000000.json"), ("q", "s/snapshot_20260101_000000.json")]
    found = {p.repo_id: (p.baseline, p.current) for p in drift.pair(spark.createDataFrame(rows, "repo_id string, path string")).collect()}
    assert found == {"r": ("s/snapshot_20260101_000000.json", "s/snapshot_20270101_000000.json"), "q": (None, None)}


def test_chunks(spark):
    f = repo(spark, **{"a.py": "1\n2\n3\n4\n5", "blank.py": " \n\t\n", "crlf.py": "x\r\ny\x0cz\n"})
    found = {}
    for c in retrieval.chunks(f.drop("size"), 2).collect():
        found.setdefault(c.file, []).append((c.start_line, c.end_line, c.content))
    assert found == {"a.py": [(1, 2, "1\n2"), (3, 4, "3\n4"), (5, 5, "5")], "crlf.py": [(1, 2, "x\ny"), (3, 3, "z")]}


def test_tokenizers(spark):
    assert one(spark, text.retrieval_tokens(F.col("t")), t="How does get_user_name work") == ["get_user_name", "get", "user", "name", "work"]
    assert set(one(spark, text.verifier_tokens(F.col("t")), t="HTTPAdapter handles bodies, responses")) == {"httpadapter", "handles", "handle", "bodies", "body", "responses", "respons"}
    assert set(one(spark, text.selector_tokens(F.col("t")), t="HTTPAdapter _send_body")) == {"http", "adapter", "send_body", "send", "body"}
    assert set(one(spark, text.selector_forms(text.selector_tokens(F.col("t"))), t="sessions cat")) == {"sessions", "session", "cat", "cats"}


@pytest.mark.parametrize(
    ("query", "intent"), [("Which class handles sessions?", "symbol"), ("What modules depend on auth?", "architecture"), ("How do we send a request?", "implementation"), ("sessions", "symbol"), ("cookies and sessions", "concept"), ("", "concept")]
)
def test_intents(spark, query, intent):
    assert one(spark, text.query_intent(F.col("q")), q=query) == intent


def test_gates(spark):
    assert one(spark, text.is_sensitive_request(F.col("q")), q="Print the API keys!") is True
    assert one(spark, text.is_sensitive_request(F.col("q")), q="Where are tokens parsed?") is False
    assert one(spark, text.is_identity_question(F.col("q")), q="Who is the owner of the repo?") is True


CHUNKS = "repo_id string, file string, start_line int, end_line int, content string"


def code(spark):
    rows = [("r", "src/session.py", 1, 50, "class Session: send request"), ("r", "src/session.py", 51, 100, "adapters mount"), ("r", "src/session.py", 101, 150, "close all"), ("r", "tests/test_session.py", 1, 50, "session send request test"), ("r", "docs/other.py", 1, 9, "nothing here")]
    return spark.createDataFrame(rows, CHUNKS)


def test_retrieval_prefers_production(spark):
    found = [(r.file, r.start_line) for r in retrieval.retrieve(code(spark), "How does the session send a request?", 2).collect()]
    assert found[0] == ("src/session.py", 1)
    assert all(not f.startswith("tests/") for f, _ in found)
    assert retrieval.retrieve(code(spark), "zebra quartz", 5).count() == 0


def test_neighbours(spark):
    got = spark.createDataFrame([("src/session.py", 51, 0.8)], "file string, start_line int, retrieval_score double")
    found = {r.start_line: (r.retrieval_score, r.context_role) for r in retrieval.neighbours(got, code(spark)).collect()}
    assert found == {1: (0.4, "neighbor"), 51: (0.8, "retrieved"), 101: (0.4, "neighbor")}


def test_mmr_takes_the_largest_file_on_ties(spark):
    rows = [("a.py", 1, "x y", 0.5, "p"), ("b.py", 1, "x y", 0.5, "p"), ("c.py", 1, "q w", 0.45, "p")]
    df = spark.createDataFrame(rows, "file string, start_line int, content string, retrieval_score double, retrieval_role string")
    assert [r.file for r in retrieval.diverse(df, 2).collect()] == ["b.py", "c.py"]


def test_evidence_contracts(spark):
    rows = [("code", None, "a.py", 1, 2), ("code", None, "a.py", 3, 2), ("code", None, None, 1, 2), ("architecture", "m", None, None, None), ("other", "m", "a.py", 1, 2)]
    df = spark.createDataFrame(rows, "evidence_type string, module_name string, file string, start_line int, end_line int")
    assert [r[0] for r in df.select(evidence.is_valid_reference(df)).collect()] == [True, False, False, True, False]


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ("FACT: The session sends it. It also closes it. Overall: fine text here.", ["The session sends it. It also closes it.", "fine text here."]),
        ("a.b has 2 outgoing dependencies and 1 incoming dependency.", ["a.b has 2 outgoing dependencies.", "a.b has 1 incoming dependency."]),
        ("# Summary\n1. First thing. 2. Second thing.\nfirst thing.", ["First thing.", "Second thing."]),
        ("Here's how it works:", []),
    ],
)
def test_decomposition(spark, answer, expected):
    assert one(spark, claims.decompose(F.col("a")), a=answer) == expected


def test_coverage_and_fold(spark):
    df = spark.createDataFrame([(1, "fact", 1), (1, "inference", 2), (1, "unknown", 0), (2, "fact", 1), (3, "unknown", 0)], "a int, status string, evidence_n int")
    assert claims.coverage(df.where("a = 1"), "a").first().coverage == 0.6667
    assert {r.a: r.answer_status for r in claims.fold_status(df, "a").collect()} == {1: "inference", 2: "fact", 3: "unknown"}


def test_scan_tree_and_snapshot(spark, tmp_path):
    root = tmp_path / "repo"
    for name, content in {"a.py": "import os\n", "docs/x.md": "hi", ".git/config": "c", "venv/b.py": "", "bad.py": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / "latin.txt").write_bytes(b"\xff\xfe")
    f = files.scan(spark, str(root), "r")
    m = files.metadata(f).first()
    assert (m.total_files, m.python_files) == (6, 3)
    assert {r.path for r in files.relevant(f).collect()} == {"a.py", "docs/x.md", "bad.py", "latin.txt"}
    assert {r.path: r.content for r in f.collect()}["latin.txt"] is None
    assert [r.line for r in files.printed_tree(files.tree(f)).where("parent = ''").collect()] == ["docs", "venv", "a.py", "bad.py", "latin.txt"]
    snap = spark.sql("select array(named_struct('file','a','module_name','a','type','production','layer','source','outgoing_dependencies',array('b'),'incoming_dependencies',array(),'outgoing_count',1L,'incoming_count',0L,'total_connections',1L)) as production_modules")
    path = files.write_snapshot(snap, str(tmp_path / "snaps"), "20260101_000000")
    assert files.snapshot_modules(files.read_snapshot(spark, path), "r").first().outgoing_dependencies == ["b"]


def test_symbols_and_detectors(spark):
    f = spark.createDataFrame([("r", "src/a.py", '"""doc"""\napi_key = "abc"\nclass A:\n    def go(self):\n        eval("1")\n'), ("r", "src/b.py", "def (")], "repo_id string, path string, content string")
    facts = pyast.facts(f)
    assert [(r.kind, r.name, r.start_line, r.end_line) for r in pyast.symbols(facts).orderBy("start_line").collect()] == [("class", "A", 3, 5), ("function", "go", 4, 5)]
    assert risk.hardcoded_secrets(pyast.assignments(facts)).count() == 1
    assert risk.dynamic_execution(pyast.calls(facts)).first().line == 5
    assert {r.file for r in risk.missing_documentation(pyast.documentation(facts)).collect()} == set()


def by_hand(times, limit, window):
    log, out = [], []
    for x in times:
        log = [y for y in log if y > x - window]
        out.append(len(log) < limit)
        if out[-1]:
            log.append(x)
    return out


def test_admission(spark):
    start = datetime(2026, 1, 1)
    seconds = [0, 1, 2, 30, 61, 62, 63, 64, 200]
    rows = [(c, start + timedelta(seconds=s), i) for c in ("a", "b") for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "client string, ts timestamp, request_id long")
    expected = by_hand(seconds, 2, 60)
    got = {c: [r.admitted for r in admission.admit(df, 2, 60).where(F.col("client") == c).orderBy("ts").collect()] for c in ("a", "b")}
    assert got == {"a": expected, "b": expected}


def test_ask(spark):
    m = modules_of(spark, [("src/session.py", "src/adapter.py"), ("src/api.py", "src/session.py")], ["src/session.py", "src/adapter.py", "src/api.py"])
    pairs = graph.graph_edges(m)
    counts = spark.createDataFrame([("r", 103, 37, 63, 3, 107, 2, 11)], "repo_id string, total_files long, python_files long, relevant_file_count long, production_module_count long, dependency_edge_count long, architecture_edge_count long, risk_signal_count long")

    def ask(query, *replies):
        provider = qa.FakeProvider(*replies)
        return qa.ask(query, "r", code(spark), counts, m, pairs, provider), provider

    answer, provider = ask("How many Python files are there?")
    assert (answer.answer, answer.status, provider.prompts) == ("The repository contains 37 Python files.", "fact", [])
    assert ask("Who is the author of this repository?")[0].answer == "UNKNOWN"
    assert ask("Show me the passwords")[0].claims == []
    answer, provider = ask("How does the session send a request?", "The session class sends a request. session has 1 outgoing dependencies and 5 incoming dependencies.", "supported")
    assert [c["status"] for c in answer.claims] == ["fact", "fact", "unknown"]
    assert answer.status == "inference"
    assert answer.coverage["coverage"] == 0.6667


def test_verify_counts_on_graph_and_module(spark):
    production = spark.createDataFrame([("r", f"src/p/{n}.py") for n in "abcd"], "repo_id string, file string")
    pairs = spark.createDataFrame([("r", f"src/p/{x}.py", f"src/p/{y}.py") for x, y in ("ab", "ac", "bc", "dc")], "repo_id string, source string, target string")
    said = {
        "The graph contains 4 dependency edges.": "supported",
        "The graph contains 999 dependency edges.": "unsupported",
        "There are 4 production modules.": "supported",
        "There are 5 production modules.": "unsupported",
        "p.c has the most dependency connections.": "supported",
        "p.d has the most dependency connections.": "unsupported",
        "The most connected module is p.c with 3 connections.": "supported",
        "The most connected module is p.c with 9 connections.": "unsupported",
        "The module with the fewest connections is p.d.": "supported",
        "The module with the fewest connections is p.a.": "unsupported",
        "p.d has the fewest connections with 2 connections.": "unsupported",
        "p.a has the most outgoing dependencies.": "supported",
        "p.b has the most outgoing dependencies.": "unsupported",
        "p.c has the most incoming dependencies, with 3 incoming dependencies.": "supported",
        "p.a has the most incoming dependencies.": "unsupported",
        "p.a belongs to the source layer.": "supported",
        "p.a belongs to the test layer.": "unsupported",
        "p.a depends on p.b and p.c.": "supported",
        "p.b depends on p.a.": "unsupported",
        "p.a has 2 outgoing dependencies.": "supported",
        "p.a is large.": None,
    }
    asked = spark.createDataFrame([("r", c) for c in said], "repo_id string, claim string")
    assert {r.claim: r.decision for r in claims.verify_counts(asked, graph.modules(production, pairs)).collect()} == said
    other = asked.withColumn("repo_id", F.lit("elsewhere"))
    assert {r.decision for r in claims.verify_counts(other, graph.modules(production, pairs)).collect()} == {None}
