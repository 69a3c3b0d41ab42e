"""Streams over several micro-batches against the same rows as a batch."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.operators import drift
from strata.streaming import admission, feed

START = datetime(2026, 1, 1)
SCHEMA = "client string, ts timestamp, request_id long"


def at(client, seconds, i):
    return (client, START + timedelta(seconds=seconds), i)


def run(spark, tmp_path, batches, build, name):
    """One micro-batch for each list of rows; the rows that come out."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "made" / str(i)))
        (part,) = (p for p in os.listdir(tmp_path / "made" / str(i)) if p.endswith(".parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(tmp_path / "made" / str(i) / part, tmp_path / "in" / f"{i:03d}.parquet")
        os.utime(tmp_path / "in" / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return query, spark.table(name).collect()


def test_admission_over_batches(spark, tmp_path):
    """Idle clients, rows out of order within the delay, and a client that comes back inside its window after many batches."""
    rng = random.Random(7)
    first = [at("a", s, s) for s in (0, 1, 2)] + [at("b", 5, 1)]
    second = [at("c", s, i) for i, s in enumerate(rng.choices(range(3, 20), k=30))] + [at("b", 4, 2)]
    third = [at("a", 59, 9), at("a", 58, 8), at("a", 61, 10), at("a", 62, 11), at("b", 66, 3)]
    fourth = [at("a", 119, 12), at("a", 121, 13), at("a", 122, 14), at("c", 118, 99), at("b", 119, 4)]
    last = [at("flush", 1000, 0)]
    batches = [first, second, third, fourth, last]
    rows = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    expected = sorted(tuple(r) for r in admission.admit(rows, 2, 60).where("client != 'flush'").collect())
    query, found = run(spark, tmp_path, batches, lambda s: admission.admit_stream(s, 2, 60, "15 seconds"), "admitted")
    assert sorted(tuple(r) for r in found) == expected and {r.admitted for r in found} == {True, False}
    assert admission.dropped(query) == 0


def test_late_requests_are_counted(spark, tmp_path):
    batches = [[at("a", 0, 0), at("a", 100, 1)], [at("b", 200, 2)], [at("a", 5, 3), at("a", 201, 4)], [at("flush", 900, 5)]]
    query, found = run(spark, tmp_path, batches, lambda s: admission.admit_stream(s, 1, 60, "10 seconds"), "late_admitted")
    assert sorted((r.client, r.request_id, r.admitted) for r in found) == [("a", 0, True), ("a", 1, True), ("a", 4, True), ("b", 2, True)]
    assert admission.dropped(query) == 1


def test_sessions_over_batches(spark, tmp_path):
    rng, batches, kept, seen = random.Random(3), [], [], 0
    for n in range(4):
        rows = [at(rng.choice("ab"), 600 * n + rng.randint(0, 500), 100 * n + i) for i in range(12)]
        if n == 3:
            rows.append(at("a", 7, 999))  # far behind the watermark
        kept += [r for r in rows if r[2] != 999]
        batches.append(rows)
    batches.append([at("flush", 9000, 0)])
    query, found = run(spark, tmp_path, batches, lambda s: admission.sessions(s, "2 minutes", "1 minute"), "sessions")
    expected = []
    for client in "ab":
        group = []
        for ts in sorted(t for c, t, _ in kept if c == client):
            if group and ts - group[-1] >= timedelta(minutes=2):
                expected.append((client, group[0], group[-1] + timedelta(minutes=2), len(group)))
                group = []
            group.append(ts)
        expected.append((client, group[0], group[-1] + timedelta(minutes=2), len(group)))
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert admission.dropped(query) == 1
    whole = admission.sessions(spark.createDataFrame(kept, SCHEMA), "2 minutes")
    assert sorted(tuple(r) for r in whole.collect()) == sorted(expected)


def test_stalest(spark):
    logs = spark.createDataFrame([(f"c{i}", (i * 37) % 101) for i in range(101)], "client string, last long")
    assert admission.stalest(logs, 101, 10).count() == 0
    assert [r.last for r in admission.stalest(logs, 100, 10).orderBy("last").collect()] == list(range(10))


# --- snapshots ------------------------------------------------------------------------


def snapshot(*modules):
    return {"metadata": {"repository_name": "r"}, "production_modules": [{"file": f, "layer": layer, "outgoing_dependencies": out} for f, layer, out in modules]}


VERSIONS = {
    "20260101_000000": [("a.py", "source", ["b.py"]), ("b.py", "source", [])],
    "20260102_000000": [("a.py", "source", ["c.py"]), ("c.py", "source", [])],
    "20260103_000000": [("a.py", "other", ["c.py"]), ("c.py", "source", []), ("d.py", "source", [])],
}


def put(directory, repo, stamp, modules):
    (directory / repo).mkdir(parents=True, exist_ok=True)
    (directory / repo / f"snapshot_{stamp}.json").write_text(json.dumps(snapshot(*modules)))


def expected(spark, old, new):
    rows = lambda ms: spark.createDataFrame([("r", i, *m) for i, m in enumerate(ms)], "repo_id string, pos int, file string, layer string, outgoing_dependencies array<string>")
    return drift.report(rows(VERSIONS[old]), rows(VERSIONS[new])).drop("repo_id").first().asDict()


@pytest.mark.parametrize("together", [False, True])
def test_snapshot_feed(spark, tmp_path, together):
    source, home, stamps = tmp_path / "snapshots", str(tmp_path / "home"), sorted(VERSIONS)
    source.mkdir()
    steps = [stamps] if together else [[s] for s in stamps]
    for step in steps:
        for s in step:
            put(source, "r", s, VERSIONS[s])
        put(source, "other", stamps[0], VERSIONS[stamps[0]])
        assert feed.follow(feed.arriving(spark, str(source)), home, availableNow=True).awaitTermination(300)
    found = {(r.baseline, r.current): r.asDict() for r in feed.reports(spark, home).where("repo_id = 'r'").collect()}
    assert feed.reports(spark, home).count() == len(found) == 2
    for old, new in zip(stamps, stamps[1:]):
        row = found[f"snapshot_{old}.json", f"snapshot_{new}.json"]
        assert {k: v for k, v in row.items() if k not in ("repo_id", "baseline", "current")} == expected(spark, old, new)
    assert {(r.repo_id, r.name) for r in feed.newest(spark, home).collect()} == {("r", f"snapshot_{stamps[-1]}.json"), ("other", f"snapshot_{stamps[0]}.json")}


def test_replayed_batches_change_nothing(spark, tmp_path):
    home, stamps = str(tmp_path / "home"), sorted(VERSIONS)

    def batch(stamp):
        row = ("r", f"snapshot_{stamp}.json", [(f, layer, out) for f, layer, out in VERSIONS[stamp]])
        df = spark.createDataFrame([row], "repo_id string, name string, production_modules array<struct<file:string,layer:string,outgoing_dependencies:array<string>>>")
        return df.select("repo_id", F.to_timestamp(F.substring("name", 10, 15), "yyyyMMdd_HHmmss").alias("snapshot_ts"), "name", "production_modules")

    def state():
        return sorted(map(str, feed.reports(spark, home).collect())), sorted(map(str, feed.newest(spark, home).collect()))

    for i, s in enumerate(stamps):
        feed.commit(batch(s), i, home)
    before = state()
    for i in (2, 1, 2):
        feed.commit(batch(stamps[i]), i, home)
    assert state() == before and len(before[0]) == 2
    feed.commit(batch(stamps[0]), 3, home)  # an older version that comes late
    assert state() == before
