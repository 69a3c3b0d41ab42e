"""Steps that many queries share: modules in one grouping, pairs by keys."""

from __future__ import annotations

from strata.operators import graph, risk
from strata.queries import tables

PAIR = "repo_id string, source string, target string"


def rows(df):
    return sorted((r.repo_id, r.file, r.outgoing_dependencies, r.incoming_dependencies, r.outgoing_count, r.incoming_count, r.total_connections) for r in df.collect())


def test_modules_take_one_shuffle(spark):
    production = spark.createDataFrame([("r", f"src/{f}.py") for f in "abcd"] + [("s", "src/a.py")], "repo_id string, file string")
    pairs = spark.createDataFrame([("r", "src/b.py", "src/a.py"), ("r", "src/c.py", "src/a.py"), ("r", "src/a.py", "src/c.py"), ("r", "lib/x.bin", "src/a.py")], PAIR)
    found = graph.modules(production, pairs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # A pair's end that is no production file has no row of its own but stays a neighbour.
    assert rows(found) == [
        ("r", "src/a.py", ["src/c.py"], ["lib/x.bin", "src/b.py", "src/c.py"], 1, 3, 4), ("r", "src/b.py", ["src/a.py"], [], 1, 0, 1), ("r", "src/c.py", ["src/a.py"], ["src/a.py"], 1, 1, 2),
        ("r", "src/d.py", [], [], 0, 0, 0), ("s", "src/a.py", [], [], 0, 0, 0),
    ]
    assert rows(graph.modules(production, pairs.limit(0))) == [(r, f, [], [], 0, 0, 0) for r, f in sorted((p.repo_id, p.file) for p in production.collect())]


def test_pairs_by_keys_are_those_by_paths(spark, small):
    for by in ("nation", "customer"):
        r = tables.Repository(spark, small, by)
        plain = graph.production_pairs(r.edges, r.production)
        assert r.pairs.count() > 0 and sorted(map(tuple, r.pairs.collect())) == sorted(map(tuple, plain.collect()))


def test_pairs_are_not_grouped_by_paths(spark, small):
    pairs = tables.Repository(spark, small, "customer", once=("lines", "files", "edges", "pairs")).pairs
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "HashAggregate" in line and "source" in line]


def test_components_by_numbers(spark, monkeypatch):
    """Large repositories go by numbers: no table that is written round by round has a node's name, and two nodes never share a number."""
    written, write = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.setdefault(name, []).append(df.dtypes) or write(df, name))
    edges = [("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c"), ("r", "c", "d"), ("r", "d", "c"), ("r", "e", "e"), ("r", "x", "a"), ("s", "a", "b"), ("s", "b", "a"), ("s", "b", "a"), ("s", "y", "z")]
    found = graph.components(spark.createDataFrame(edges, PAIR), 0)
    assert sorted(map(tuple, found.collect())) == [("r", "a", "a"), ("r", "b", "a"), ("r", "c", "c"), ("r", "d", "c"), ("r", "e", "e"), ("s", "a", "a"), ("s", "b", "a")]
    rounds = [d for name in ("numbers", "colours", "reached", "inner", "edges", "nodes") for d in written.get(name, [])]
    assert rounds and not [d for d in rounds if "string" in dict(d).values()]


def test_local_components_over_batches(spark, monkeypatch):
    """A task trims many repositories at once; one that batches cut in two stays whole."""
    import pandas as pd

    monkeypatch.setattr(graph, "BATCH_EDGES", 3)
    rows = [("a", "x", "y"), ("a", "y", "x"), ("b", "p", "q"), ("b", "q", "r"), ("b", "r", "p"), ("b", "r", "z"), ("c", "x", "y"), ("d", "s", "s"), ("d", "k", "s")]
    frames = [pd.DataFrame(rows[i : i + 2], columns=["repo_id", "source", "target"]) for i in range(0, len(rows), 2)]
    found = pd.concat(graph._local_components(iter(frames)))
    assert sorted(found.itertuples(index=False, name=None)) == [("a", "x", "x"), ("a", "y", "x"), ("b", "p", "p"), ("b", "q", "p"), ("b", "r", "p"), ("d", "s", "s")]


def test_edges_are_computed_once(spark, small):
    """Trimming does not repeat what derives the edges."""
    found = graph.components(tables.Repository(spark, small, "customer", once=("lines",)).calls)
    assert "lineitem" not in found._jdf.queryExecution().executedPlan().toString()


def test_repositories_without_a_cycle(spark):
    """What a task finds may be nothing, alone or beside others' components."""
    none = spark.createDataFrame([("a", "x", "y"), ("a", "y", "z"), ("b", "x", "z")], PAIR)
    assert graph.components(none).count() == 0 and graph.cycles(none).count() == 0
    both = none.union(spark.createDataFrame([("c", "x", "y"), ("c", "y", "x")], PAIR))
    assert sorted(map(tuple, graph.components(both).collect())) == [("c", "x", "x"), ("c", "y", "x")]


def test_no_circular_claims(spark):
    """Repositories without cycles give no claims, those beside them theirs."""
    claims = lambda df: [r.text for r in risk.risk_claims(risk.union_signals(risk.circular_dependencies(df))).collect()]
    none = spark.createDataFrame([("a", "x.py", "y.py"), ("a", "y.py", "z.py"), ("b", "x.py", "z.py")], PAIR)
    assert claims(none) == []
    ring = spark.createDataFrame([("c", "x.py", "y.py"), ("c", "y.py", "x.py")], PAIR)
    assert claims(none.union(ring)) == ["Circular dependency detected across 2 production modules: x.py, y.py."]
