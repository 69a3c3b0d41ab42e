"""The dataset manifest against trees built by hand."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("strata.llm")

from pyspark.sql import functions as F  # noqa: E402
from tests.llm import cases  # noqa: E402

from strata.llm import manifest  # noqa: E402

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def by_hand(rows):
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = defaultdict(list)
    for r in rows:
        leaf = row_digest(r, r["text"])
        hit = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        groups[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf), r["doc_id"], leaf, row_digest(r, r["text"].translate(upper)) if hit else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in names}
    whole = levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for i, (_, doc_id, leaf, now) in enumerate(sorted(groups[s])):
            siblings, digest = [], now
            for tree, k in ((trees[s], i), (whole, g)):
                for nodes in tree[:-1]:
                    first = k // 16 * 16
                    run = nodes[first : first + 16]
                    siblings += run[: k - first] + run[k - first + 1 :]
                    digest = sha([*run[: k - first], digest, *run[k - first + 1 :]])
                    k //= 16
            out.append((doc_id, leaf, trees[s][-1][0], whole[-1][0], sha(siblings), digest, digest == whole[-1][0]))
    return sorted(out, key=repr)


def verified(docs):
    return cases.as_rows(manifest.verify(docs, manifest.tampered(F.col("text"), F.col("doc_id"))), *NAMES)


def test_awkward_documents(spark):
    docs = cases.documents(spark).unionByName(cases.documents(spark).where("doc_id in (3, 8)").withColumn("source", F.lit("alone ä")))
    assert verified(docs) == by_hand([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("near", [2, 3, 4])
def test_many_levels_and_a_hot_source(spark, monkeypatch, near):
    monkeypatch.setattr(manifest, "NEAR", near)
    monkeypatch.setattr(manifest, "ROWS", 100)
    rows = [(i, f"Text {i % 97} of it", "en", "hot" if i % 3 else f"s{i % 60}", i) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    found = verified(docs)
    assert found == by_hand([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in found} == {True, False}


def test_no_documents_and_one(spark):
    assert verified(cases.empty(spark)) == []
    one = cases.documents(spark).where("doc_id = 4")
    ((_, leaf, subroot, root, proof, *_),) = verified(one)
    assert leaf == subroot == root and proof == sha([])


def test_any_change_shows(spark):
    docs = cases.documents(spark).where("doc_id > 5")
    changed = manifest.verify(docs, F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))))
    assert {r.doc_id for r in changed.where("not verified").collect()} == {r.doc_id for r in docs.where("doc_id % 7 = 0").collect()}
