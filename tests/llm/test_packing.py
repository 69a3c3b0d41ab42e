"""Packing against a plain best fit and the contract of its pieces."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("strata.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm import cases  # noqa: E402

from strata.llm import packing  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, size):
    rooms = []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return Counter(rooms)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 100, 2048])
def test_best_fit(size):
    rng = random.Random(size)
    for many in (0, 1, 30, 400):
        lengths = sorted((rng.randint(1, size) for _ in range(many)), reverse=True)
        windows, offsets = packing.best_fit(lengths, size)
        used = defaultdict(int)
        for n, w, at in zip(lengths, windows, offsets):
            assert used[w] == at
            used[w] += n
        assert sorted(used) == list(range(len(used)))
        assert Counter(size - u for u in used.values()) == plain_best_fit(lengths, size)


def test_tightest_window():
    rng, opened, held = random.Random(5), packing.OpenWindows(50), []
    for n in range(2000):
        if rng.random() < 0.55:
            held.append((room := rng.randint(1, 50), n))
            opened.put(n, room)
        least = rng.randint(1, 50)
        fits = [h for h in held if h[0] >= least]
        found = opened.tightest(least)
        if not fits:
            assert found is None
        else:
            assert (found[1], found[0]) in held and found[1] == min(fits)[0]
            held.remove((found[1], found[0]))


@pytest.mark.parametrize(("size", "group"), [(2048, 4096), (32, 5), (64, 1)])
def test_pieces(spark, size, group):
    from tokenizers import Tokenizer

    library, docs = Tokenizer.from_file(TOKENIZER), cases.documents(spark).repartition(3)
    found = packing.pack(docs, TOKENIZER, size=size, group=group).collect()
    expected = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), size):
            part = ids[at : at + size]
            expected[r.doc_id, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert all(at == sum(n for _, n in held[:k]) for k, (at, _) in enumerate(held)) and sum(n for _, n in held) <= size
    again = packing.pack(docs.repartition(2), TOKENIZER, size=size, group=10**6).groupBy("sequence_id").count().count()
    assert again <= len(sequences)


def test_padding_is_small(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    used = [r.n for r in packing.pack(docs, TOKENIZER).groupBy("sequence_id").agg({"length": "sum"}).toDF("id", "n").collect()]
    assert sum(2048 - n for n in used if n & (n - 1)) < 0.02 * sum(used)  # a few windows of 97


def test_no_documents(spark):
    assert packing.pack(cases.empty(spark), TOKENIZER).count() == 0
