"""Binned joins of line ranges against all pairs of a file."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import ranges, retrieval


def made(rng, many, files, span):
    rows = []
    for _ in range(many):
        start = rng.randint(1, 3000)
        rows.append((rng.choice(files), start, start + rng.choice([0, 1, rng.randint(0, span)])))
    return rows


def frames(spark, left, right):
    a = spark.createDataFrame(left, "file string, start_line int, end_line int")
    return a, spark.createDataFrame(right, "file string, start_line int, end_line int")


@pytest.mark.parametrize("size", [1, 10, 256])
def test_overlap_and_containment(spark, monkeypatch, size):
    monkeypatch.setattr(ranges, "BIN", size)
    rng = random.Random(size)
    left, right = made(rng, 120, ["a\\x.py", "A/X.py", "b.py"], 600), made(rng, 120, ["a/x.py", "b.py", "c.py"], 600)
    left += [("b.py", None, 4), ("b.py", 3, None), ("zz", None, None), ("b.py", 400, 300), left[0]]
    a, b = frames(spark, left, right)
    normal = lambda f: spark.range(1).select(retrieval.paths.backslashed(F.lit(f))).first()[0]
    names = {f: normal(f) for f in {x[0] for x in (*left, *right)}}
    meets = lambda x, y: names[x[0]] == names[y[0]] and (x[1] is None or x[2] is None or (x[1] <= y[2] and y[1] <= x[2]))
    expected = {(*x, y[1], y[2]) for x in left for y in right if meets(x, y)}
    found = [tuple(r) for r in retrieval.overlapping(a, b).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    inside = [x for x in left if None not in x and any(x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in right)]
    assert sorted(tuple(r) for r in retrieval.contained(a, b).collect()) == sorted(inside)


def test_one_giant_file(spark):
    """A million lines: symbols find their chunks, and no key of the join has more than a bin's rows."""
    chunks = spark.range(20_000).select(F.lit("big.py").alias("file"), (F.col("id") * 50 + 1).cast("int").alias("start_line"), (F.col("id") * 50 + 50).cast("int").alias("end_line"))
    symbols = spark.range(20_000).select(
        F.lit("big.py").alias("file"), F.lit("function").alias("kind"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), (F.col("id") * 50 + 30).cast("int").alias("start_line"), (F.col("id") * 50 + 70).cast("int").alias("end_line")
    )
    found = retrieval.attach_symbols(chunks, symbols)
    row = found.agg(F.count("*").alias("n"), F.sum(F.size("symbols.functions")).alias("symbols"), F.max(F.size("symbols.functions")).alias("most")).first()
    assert (row.n, row.symbols, row.most) == (20_000, 2 * 20_000 - 1, 2)
    bins = chunks.select(F.explode(ranges._bins(F.col("start_line"), F.col("end_line"))).alias("bin")).groupBy("bin").count().agg(F.max("count"), F.count("*")).first()
    assert bins[0] <= 8 and bins[1] > 3000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_bin_a" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
