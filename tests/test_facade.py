"""A repository on disk, from files to answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.operators import graph, retrieval, selection
from strata.plans import facade, provider, qa, service
from strata.sources import artifacts, files

TREE = {
    "src/app/__init__.py": "",
    "src/app/api.py": '"""Api."""\nfrom . import session\n\n\nclass Api:\n    def send(self):\n        return session.Session()\n',
    "src/app/session.py": "from app import adapter\n\nsecret_key = 'abc123'\n\n\nclass Session:\n    def send(self, request):\n        return adapter.send(request)\n",
    "src/app/adapter.py": "from app import session\n\n\ndef send(request):\n    return eval('request')\n",
    "tests/test_api.py": "from app import api\n",
    "README.md": "# app\n",
    "broken.py": "def (\n",
}


def test_analysis_and_questions(spark, tmp_path):
    for name, content in TREE.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(content)
    a = facade.Analysis(files.scan(spark, str(tmp_path / "repo"), "r"))
    overview = a.overview().first()
    assert (overview.total_files, overview.python_files, overview.production_module_count) == (7, 6, 5)
    pairs = {(e.source, e.target) for e in a.module_edges.collect()}
    assert pairs == {("src/app/api.py", "src/app/session.py"), ("src/app/session.py", "src/app/adapter.py"), ("src/app/adapter.py", "src/app/session.py")} | {(f"src/app/{m}.py", "src/app/__init__.py") for m in ("session", "adapter")}
    signals = {(s.signal, s.file) for s in a.signals.collect()}
    assert ("circular_dependency", None) in signals and ("possible_hardcoded_secret", "src/app/session.py") in signals
    assert ("dynamic_code_execution", "src/app/adapter.py") in signals and ("missing_test_counterpart", "src/app/api.py") not in signals
    silent = qa.FakeProvider("never")
    assert a.ask("How many Python files are there?", "r", silent).answer == "The repository contains 6 Python files."
    assert a.ask("What does app.session depend on?", "r", silent).answer.startswith("app.session has 2 outgoing dependencies: ")
    assert silent.prompts == []
    told = a.ask("How does the Session class send a request?", "r", qa.FakeProvider("Session sends a request through the adapter.", "supported"))
    assert (told.status, told.coverage["coverage"]) == ("fact", 1.0)
    assert "src/app/session.py" in {e["file"] for e in told.evidence}

    snaps = tmp_path / "snaps"
    first = files.write_snapshot(a.snapshot().drop("repo_id"), str(snaps), "20260101_000000")
    listed = spark.createDataFrame([("r", first)], "repo_id string, path string")
    assert facade.drift_report(spark, listed).first().status == "unconfigured"
    changed = a.snapshot().withColumn("production_modules", F.filter("production_modules", lambda m: ~m["file"].contains("adapter"))).drop("repo_id")
    second = files.write_snapshot(changed, str(snaps), "20260102_000000")
    report = facade.drift_report(spark, listed.union(spark.createDataFrame([("r", second)]))).first()
    assert (report.status, report.removed, report.has_drift) == ("ready", 1, True)
    moved = facade.module_drift(spark, listed.union(spark.createDataFrame([("r", second)])))
    risky = facade.Analysis(files.scan(spark, str(tmp_path / "repo"), "r"), drift=moved).signals
    assert {(s.signal, s.file, s.severity) for s in risky.where("signal = 'architecture_drift'").collect()} == {("architecture_drift", "src/app/adapter.py", "medium")}
    assert facade.module_drift(spark, listed).count() == 0
    assert facade.load_snapshot(spark, str(tmp_path / "none"), None, second).count() == 1
    assert facade.load_snapshot(spark, None, str(tmp_path / "none")) is None


def test_architecture_item_and_context(spark):
    rows = [("graph_summary", None, None, 0), ("module", "app.session", "src/app/session.py", 1), ("module", "app.api", "src/app/api.py", 2)]
    items = spark.createDataFrame(rows, "evidence_subtype string, module_name string, file string, pos int")
    assert selection.architecture_item(items, "app.session has 2 outgoing dependencies").first().module_name == "app.session"
    assert selection.architecture_item(items, "zebra").first().evidence_subtype == "graph_summary"
    chunks = spark.createDataFrame([("a.py", 1, 5, "session send", "send", 0), ("b.py", 1, 5, "session", "", 1), ("c.py", 1, 5, "none", "", 2)], "file string, start_line int, end_line int, content string, symbol_names string, pos int")
    best = selection.focused_context(chunks, "send session", "symbol", 1)
    assert best.first().file == "a.py"
    assert [r.file for r in selection.supporting_context(chunks, "send session", "general", best).collect()] == ["b.py", "c.py"]
    assert selection.supporting_context(chunks, "send session", "symbol", best).count() == 0
    assert selection.context_text(best.withColumn("rank", F.lit(1))).first().context == "[1] a.py:1-5\nsession send"


def test_drift_of_many_repositories(spark, tmp_path):
    shape = "named_struct('file',f,'module_name',f,'type','production','layer','source','outgoing_dependencies',d,'incoming_dependencies',array(),'outgoing_count',1L,'incoming_count',0L,'total_connections',1L)"
    listed = []
    for r in range(4):
        for day, names in ((1, ("a", "b")), (2, ("a", "c")))[: 2 if r < 3 else 1]:
            rows = " union all ".join(f"select '{n}{r}' as f, array('x{day}') as d" for n in names)
            snap = spark.sql(f"select collect_list({shape}) as production_modules from ({rows})")
            listed.append((f"r{r}", files.write_snapshot(snap, str(tmp_path / f"r{r}"), f"2026010{day}_000000")))
    found = {x.repo_id: x for x in facade.drift_report(spark, spark.createDataFrame(listed, "repo_id string, path string")).collect()}
    assert [(found[f"r{r}"].status, found[f"r{r}"].added, found[f"r{r}"].removed, found[f"r{r}"].changed_dependencies) for r in range(3)] == [("ready", 1, 1, 1)] * 3
    assert found["r3"].status == "unconfigured"


def test_artifacts_and_their_kinds(spark, tmp_path):
    chunks = spark.createDataFrame([("a.py", 1, 2, "é"), ("b.py", 1, 3, "y")], "file string, start_line long, end_line long, content string").repartition(2)
    artifacts.save_rows(chunks, str(tmp_path / "chunks.json"))
    assert {(r.file, r.content) for r in artifacts.load_rows(spark, str(tmp_path / "chunks.json")).collect()} == {("a.py", "é"), ("b.py", "y")}
    (tmp_path / "list.json").write_text('[\n {"file": "a.py", "start_line": 1, "symbols": {"classes": []}},\n {"file": "b.py"}\n]')
    (tmp_path / "object.json").write_text('{\n "metadata": {"total_files": 3},\n "relevant_files": ["a.py"]\n}')
    assert artifacts.load_rows(spark, str(tmp_path / "list.json")).count() == 2
    assert artifacts.load_object(spark, str(tmp_path / "object.json")).first().metadata.total_files == 3
    artifacts.save_object(artifacts.load_object(spark, str(tmp_path / "object.json")), str(tmp_path / "again.json"))
    assert artifacts.load_object(spark, str(tmp_path / "again.json")).first().relevant_files == ["a.py"]
    with pytest.raises(ValueError, match="object"):
        artifacts.load_object(spark, str(tmp_path / "list.json"))
    with pytest.raises(Exception, match=r"list|FAILFAST|MALFORMED"):
        artifacts.load_rows(spark, str(tmp_path / "object.json"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        artifacts.load_object(spark, str(tmp_path / "none.json"))


def small_repository(spark):
    chunks = spark.createDataFrame(
        [("r", "src/session.py", 1, 9, "class Session sends a request through the adapter"), ("r", "src/adapter.py", 1, 9, "adapter writes bytes to the socket"), ("r", "src/other.py", 1, 9, "frobnicate widgets nightly")],
        "repo_id string, file string, start_line int, end_line int, content string",
    )
    production = spark.createDataFrame([("r", f"src/{n}.py") for n in ("session", "adapter", "other")], "repo_id string, file string")
    modules = graph.modules(production, spark.createDataFrame([("r", "src/session.py", "src/adapter.py")], "repo_id string, source string, target string"))
    counts = spark.createDataFrame([("r", 3, 3, 3, 3, 1, 1, 0)], "repo_id string, total_files long, python_files long, relevant_file_count long, production_module_count long, dependency_edge_count long, architecture_edge_count long, risk_signal_count long")
    return chunks, modules, counts


def test_pool_has_all_kinds_of_evidence(spark):
    chunks, modules, counts = small_repository(spark)
    pool = service.collect_pool("How many Python files does the Session module depend on?", chunks, modules, counts)
    assert {e["evidence_type"] for e in pool} == {"code", "repository_metadata", "architecture"}
    assert [e["pos"] for e in pool] == list(range(len(pool)))
    (graph_row,) = service.architecture_evidence("Which module has the fewest connections?", modules).collect()
    assert (graph_row.evidence_subtype, graph_row.node_count, graph_row.edge_count, list(graph_row.top_outgoing)[0]) == ("graph_summary", 3, 1, "session")


def verifier(spark, *replies):
    chunks, modules, counts = small_repository(spark)
    pool = service.collect_pool("How does the Session send a request?", chunks, modules, counts)
    provider = qa.FakeProvider(*replies)
    return service.Verifier(spark, "r", pool, chunks, modules, counts, provider), provider


def test_facts_come_before_the_provider(spark):
    v, provider = verifier(spark, "supported")
    found = v.verify(["The repository contains 4 Python files.", "The repository contains 3 Python files.", "session depends on adapter.x."])
    assert [found[c][0] for c in found][:2] == ["unsupported", "supported"]
    assert not any("Python files" in p for p in provider.prompts)


def test_no_common_word_means_no_call(spark):
    v, provider = verifier(spark, "supported")
    assert v.verify(["Zebras quack."])["Zebras quack."][0] == "unsupported"
    assert provider.prompts == []


def test_retry_and_ladder(spark):
    claim = "The Session sends a request through the adapter."
    v, provider = verifier(spark, "no", '{"decision": "yes"}')
    assert v.verify([claim])[claim][0] == "supported" and len(provider.prompts) == 2
    assert provider.prompts[1].startswith("Look again")
    v, provider = verifier(spark, "no", "no", "no", "partial")
    decision, items = v.verify([claim])[claim]
    assert decision == "partially_supported" and len(items) == 1
    v, provider = verifier(spark, "no")
    assert v.verify([claim])[claim] == ("unsupported", [])

    def broken(prompt):
        raise RuntimeError

    v.provider = broken
    assert v.verify([claim])[claim] == ("unsupported", [])


def test_scan_of_all_chunks_comes_last(spark):
    claim = "Widgets frobnicate nightly."
    v, provider = verifier(spark, "supported")
    v.pool = [e for e in v.pool if e["evidence_type"] == "code" and "other" not in e["file"]]
    decision, items = v.verify([claim])[claim]
    assert decision == "supported" and [e["file"] for e in items] == ["src/other.py"]
    assert all("frobnicate" in p for p in provider.prompts)


def test_symbols_stay_in_their_repository(spark):
    rows = spark.createDataFrame([(r, "a.py", 1, 9) for r in ("x", "y")], "repo_id string, file string, start_line int, end_line int")
    names = spark.createDataFrame([("x", "a.py", "class", "X", 2, 3), ("y", "a.py", "class", "Y", 2, 3)], "repo_id string, file string, kind string, name string, start_line int, end_line int")
    assert {(r.repo_id, r.symbols.classes[0].name) for r in retrieval.attach_symbols(rows, names).collect()} == {("x", "X"), ("y", "Y")}


class Structured:
    """A provider that answers by JSON, as its prompt says."""

    def generate_json(self, prompt, schema):
        if "late" in prompt:
            raise TimeoutError("secret path")
        if "away" in prompt:
            raise ConnectionRefusedError("secret path")
        if "odd" in prompt:
            raise RuntimeError("secret path")
        return {"bad": "no json", "none": '{"reason": "x"}', "blank": " "}.get(prompt, '{"decision": "supported", "keys": "' + ",".join(schema["required"]) + '"}')


def test_replies_and_errors_by_name(spark):
    prompts = ["fine", "late", "away", "odd", "bad", "none", "blank", "", None]
    df = spark.createDataFrame([(p,) for p in prompts], "p string")
    found = {r.p: r.r for r in df.select("p", provider.generate_json(F.col("p"), Structured(), provider.DECISION_SCHEMA).alias("r")).collect()}
    assert found["fine"].error is None and '"decision"' in found["fine"].text
    assert {p: found[p].error for p in prompts[1:]} == {"late": "timeout", "away": "unavailable", "odd": "request_failed", "bad": "invalid_response", "none": "invalid_response", "blank": "invalid_response", "": "empty_prompt", None: "empty_prompt"}
    plain = {r.p: r.r for r in df.select("p", provider.generate_json(F.col("p"), lambda p: "```json\n{\"decision\": \"no\"}\n```", provider.DECISION_SCHEMA).alias("r")).collect()}
    assert plain["late"].text == '{"decision": "no"}' and plain[None].error == "empty_prompt"
    said = {r.p: r.r for r in df.select("p", provider.generate(F.col("p"), lambda p: p.upper()).alias("r")).collect()}
    assert said["late"].text == "LATE"


def test_states():
    assert provider.health("s") == {"status": "ok", "service": "s"}
    assert provider.release("s", "7", "1.0")["release"] == "7"
    probe = lambda **k: lambda: k
    assert provider.model_status("p", "m", probe(reachable=True, model_configured=True))["status"] == "ready"
    assert provider.model_status("p", "m", probe(reachable=True, model_configured=False))["status"] == "model_missing"
    assert provider.model_status("p", "m", probe(reachable=False, reason="timeout")) == {"status": "unavailable", "provider": "p", "model": "m", "reason": "timeout"}

    def broken():
        raise TimeoutError

    assert provider.model_status("p", "m", broken)["reason"] == "timeout"
