"""Vector codes against plain k-means on the same integers, and the SQL of operators 11 and 13."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pytest

pytest.importorskip("strata.llm")

from strata.llm import codes, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def by_hand(rows, parts=16, entries=64):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]
    d = len(ints[0]) // parts
    cut = [[v[p * d : p * d + d] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda a, book: min((gap(a, e), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(parts):
            held = {}
            for v in cut:
                held.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for k, vs in held.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out, total = [], {}
    for r, v in zip(kept, cut):
        best = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((r, "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best)))
        total[r[2]] = total.get(r[2], 0) + out[-1][2]
    name = codes.books_sha256(np.array(books))
    return sorted(((r[0], code, error, total[r[2]], name) for r, code, error in out), key=repr)


def found(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("many", [3, 64, 400])
def test_codes(spark, many):
    rng = np.random.default_rng(many)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.3, 32), 1).astype(np.float32)], int(i) % 5 if i % 4 else None, "c", "e") for i in rng.permutation(many)]
    rows += [rows[0], (rows[1][0], rows[2][1], 7, "c", "e"), (None, rows[1][1], None, "c", "e")]
    rows += [(-1, None, 1, "", ""), (-2, [], None, "", ""), (-3, [float("nan")] * 32, 1, "", ""), (-4, [float("-inf")] + [0.0] * 31, 1, "", ""), (-5, [None] + [0.0] * 31, 1, "", "")]
    rows += [(10**6, [1.0] * 16, 2, "", "")]
    assert found(codes.digests(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_hand(rows)


def test_nothing_kept(spark):
    assert found(codes.digests(spark.createDataFrame([], SCHEMA))) == []
    assert found(codes.digests(spark.createDataFrame([(1, None, 1, "", ""), (2, [float("inf")] * 16, 1, "", "")], SCHEMA))) == []


def test_lengths(spark):
    with pytest.raises(ValueError, match="16 equal parts"):
        codes.digests(spark.createDataFrame([(1, [1.0] * 17, 1, "", "")], SCHEMA))
    assert found(codes.digests(spark.createDataFrame([(1, [], 1, "", "")], SCHEMA))) == []
    big = found(codes.digests(spark.createDataFrame([(1, [3e38, -3e38] * 8, 1, "", ""), (2, [0.0] * 16, 1, "", "")], SCHEMA)))
    assert [r[2] for r in big] == [0, 0]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, small, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, expected = queries.QUERIES[name](spark, small), duck.execute(queries.ORACLE[name])
    columns = sorted(df.columns)
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    pick = lambda rows, given: sorted((tuple(r[given.index(c)] for c in columns) for r in rows), key=repr)
    assert pick(df.collect(), df.columns) == pick(expected.fetchall(), names)
