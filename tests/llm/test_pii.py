"""Contextual extraction against a plain re-statement, with masked seeds, and on long texts."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict
from math import prod

import pytest
from pyspark.sql import functions as F

pytest.importorskip("strata.llm")

from tests.llm import cases  # noqa: E402

from strata.llm import pii  # noqa: E402


def luhn_number(rng, digits=16):
    body = "".join(rng.choice("0123456789") for _ in range(digits - 1))
    return next(body + d for d in "0123456789" if cases.luhn(body + d))


def kind_of(value):
    return next((k for k, a, b in cases.pii_spans(value) if (a, b) == (0, len(value))), None)


def candidates(text):
    text = text or ""
    base, words, out = cases.pii_spans(text), [], []
    matches = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if re.search("[0-9@]", m[0])]
    ends = [0, *(m.end() for m in matches)]
    for i, m in enumerate(matches):
        words.append((m[0], m.start(), text[ends[i] : m.start()], text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else None]))
    for i in range(len(words)):
        for k in range(1, 5):
            part = words[i : i + k]
            if len(part) < k or any(w[2] != " " for w in part[1:]):
                continue
            raw = " ".join(w[0] for w in part)
            left = raw.lstrip(pii.EDGES)
            start, value = part[0][1] + len(raw) - len(left), left.rstrip(pii.EDGES)
            end = start + len(value)
            if not 5 <= len(value) <= 64 or ("@" not in value and len(re.sub("[^0-9]", "", value)) < 4):
                continue
            touches = any(a < end and start < b for _, a, b in base)
            kind = kind_of(value) if touches else None
            if touches and kind is None:
                continue
            before, after = (re.findall(r"[^\x20\x09-\x0D]+", x) for x in (part[0][2][-96:], part[-1][3][:96]))
            l1, l2 = ([w[-32:].lower() for w in reversed(before)] + ["", ""])[:2]
            r1 = after[0][:32].lower() if after else ""
            shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]", "9", value)))
            patterns = [("shape", shape)]
            patterns += [("before", l1), ("before+shape", l1, shape)] if l1 else []
            patterns += [("after", r1), ("after+shape", r1, shape)] if r1 else []
            patterns += [("before2", l2, l1)] if l1 and l2 else []
            patterns += [("between", l1, r1)] if l1 and r1 else []
            out.append((start, end, value, kind, [" ".join(p) for p in patterns]))
    return out


def found_by_hand(texts, support=5, confidence=0.8, rounds=3):
    """Spans of each text; three scoring rounds on plain dictionaries."""
    seen = [candidates(t) for t in texts]
    edges = defaultdict(dict)
    for _, _, value, kind, patterns in (c for row in seen for c in row):
        for p in patterns:
            edges[p][value] = max(filter(None, (edges[p].get(value), kind)), default=None)
    edges = {p: own for p, own in edges.items() if len(own) >= support}
    seeds = {(v, k): 1.0 for own in edges.values() for v, k in own.items() if k}
    scores = dict(seeds)
    for _ in range(rounds):
        sure = {}
        for p, own in edges.items():
            for kind in pii.KINDS:
                total = sum(scores.get((v, kind), 0.0) for v in own)
                if total >= support and total / (len(own) + 1) >= confidence:
                    sure[p, kind] = total / (len(own) + 1)
        doubts = defaultdict(list)
        for (p, kind), c in sure.items():
            for v, k in edges[p].items():
                if k is None:
                    doubts[v, kind].append(1 - min(c, 0.999))
        scores = {k: max(seeds.get(k, 0.0), 1 - prod(doubts[k]) if k in doubts else 0.0) for k in {*seeds, *doubts}}
    names, out = {p for p, _ in sure}, []
    for text, row in zip(texts, seen):
        spans = []
        for a, b in sorted({(a, b) for a, b, _, kind, patterns in row if kind is None and names & set(patterns)}):
            if spans and a < max(e for _, _, e in spans):
                spans[-1] = ("context", spans[-1][1], max(spans[-1][2], b))
            else:
                spans.append(("context", a, b))
        out.append(cases.joined(cases.pii_spans(text) + spans))
    return out


def fixture():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        rows.append(f"{prose(8)} card number {luhn_number(rng)} {prose(5)}")
        rows.append(f"{prose(3)} write to {word()}.{word()}@{word()}.example.com {prose(6)}")
        rows.append(f"{prose(4)} call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} {prose(2)}")
        rows.append(f"{prose(6)} order {rng.randint(10**15, 10**16 - 1)} {prose(4)}")  # looks alike, stands elsewhere
        rows.append(prose(20))
    return rows, rng


def masked():
    """Texts whose identifiers the base patterns miss, in contexts that others teach, and where they are."""
    rows, rng = fixture()
    hidden = []
    for i in range(10):
        hidden += [(f"so card number ZX-{rng.randint(10**7, 10**8)} it is", "card number "), (f"just write to user{i}2024@intranet now", "write to "), (f"and call +1 ({200 + i}) 555-{3000 + i} 170.106.47.{i} too", "call ")]
    return rows, hidden


def test_rounds_against_plain_ones(spark, docs_of):
    rows, hidden = masked()
    texts = rows + [t for t, _ in hidden] + cases.texts() + ["PIN-4455 write to 2024@x @ 77-88-99 by hand", "\x1c12345 é９９９９９ 12345", "x" * 200 + " 99 887 766 5 " + "y" * 200]
    found = pii.find(docs_of(texts)).orderBy("doc_id").collect()
    assert [r.spans for r in found] == found_by_hand(texts)
    assert sum("context" in r.spans for r in found) >= len(hidden)


def test_masked_seeds_are_found_and_clean_texts_are_not(spark, docs_of):
    rows, hidden = masked()
    found = [r.spans for r in pii.find(docs_of(rows + [t for t, _ in hidden])).orderBy("doc_id").collect()]
    assert all("context" not in s for s in found[: len(rows)])
    caught = [f"context:{t.index(lead) + len(lead)}:" in s for s, (t, lead) in zip(found[len(rows) :], hidden)]
    assert sum(caught) / len(caught) >= 0.95
    clean = pii.redact(docs_of(rows + [t for t, _ in hidden])).orderBy("doc_id").collect()
    assert "ZX-" not in " ".join(r.text for r in clean) and sum("[CONTEXT]" in r.text for r in clean) == sum(caught)
    assert [r.text for r in clean][4 : len(rows) : 5] == rows[4::5]


def test_second_generation(spark, docs_of):
    """A pattern without a single seed, learnt from instances that other patterns found."""
    rng = random.Random(5)
    rows = [f"a card number {luhn_number(rng)} ok" for _ in range(60)]
    ids = [f"QQ{i:02d}-{1000 + i}" for i in range(13)]
    rows += [f"my card number {x} fine" for x in ids]
    rows += [f"the permit {x} then" for x in ids]
    texts = [*rows, "one permit RR-778899 remains"]
    found = [r.spans for r in pii.find(docs_of(texts)).orderBy("doc_id").collect()]
    assert found == found_by_hand(texts)
    assert found[-1] == "context:11:20"
    assert pii.find(docs_of(texts), rounds=1).orderBy("doc_id").collect()[-1].spans == ""


def redacted_by_hand(text, spans):
    out, at = "", 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_redaction_against_a_plain_one(spark, docs_of):
    texts = [t for t in cases.texts() if t] + ["é" * i + " a@b.co 10.0.0.1 " * i for i in range(40)]
    found = pii.find(docs_of(texts)).orderBy("doc_id").collect()
    spans = [[(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in found]
    assert [r.text for r in pii.redact(docs_of(texts)).orderBy("doc_id").collect()] == [redacted_by_hand(t, s) for t, s in zip(texts, spans)]


def test_long_texts_take_no_square_of_their_identifiers(spark, docs_of):
    texts = ["".join(f"host{i} 10.0.{i % 256}.{i % 200} id-{10000 + i}\n" for i in range(n)) for n in (10, 16_000)]
    pii.find(docs_of(texts[:1])).collect()
    began = time.perf_counter()
    (row,) = pii.find(docs_of(texts[1:])).collect()
    assert row.n_ip == 16_000
    assert time.perf_counter() - began < 30
    (clean,) = pii.redact(docs_of(texts[1:])).collect()
    assert clean.text.count("[IP]") == 16_000 and "10.0.0.0" not in clean.text


@pytest.fixture
def docs_of(spark):
    def of(texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, F.col("doc_id"))

    return of
