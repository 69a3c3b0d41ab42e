"""Fitted models against plain re-statements, and every operator on very long texts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest

pytest.importorskip("strata.llm")

from tests.llm import cases  # noqa: E402

from strata.llm import hmm, media, mixing, pii, quality_classifier, quality_rules, secrets, simhash  # noqa: E402


def labelled(spark, n=120):
    rng = np.random.default_rng(12)
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel"]
    prose = lambda k: " ".join(rng.choice(words, k))
    texts = [prose(int(rng.integers(5, 60))) + (" click!! now$$$ 100 " * int(rng.integers(1, 5)) if i % 3 == 0 else ". Fine.") for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return texts, docs, spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")


def monotone(x, y, w):
    """Isotonic fit by the min-max formula, at each x."""
    mean = lambda a, b: np.dot(y[a : b + 1], w[a : b + 1]) / w[a : b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))])


def test_classifier_against_plain_algebra(spark):
    q = quality_classifier
    texts, docs, labels = labelled(spark)
    stats = np.array([q.statistics(t.encode()) for t in texts])
    known = [i for i in range(0, len(texts), 2) if not cases.held(i, 4)]
    y = np.array([float(i % 3 != 0) for i in known])
    scale = stats.std(axis=0)
    scale[scale <= 1e-12] = 1
    rng = np.random.default_rng(7)
    directions = rng.normal(0, 1 / np.sqrt(stats.shape[1]), (stats.shape[1], q.FOURIER))
    phases = rng.uniform(0, 2 * np.pi, q.FOURIER)
    z = np.sqrt(2 / q.FOURIER) * np.cos(np.clip((stats - stats.mean(axis=0)) / scale, -6, 6) @ directions + phases)
    z = np.hstack([z, np.ones((len(z), 1))])
    penalty = np.diag([q.RIDGE] * q.FOURIER + [q.RIDGE * 1e-9])
    raw = np.clip(z @ np.linalg.solve(z[known].T @ z[known] + penalty, z[known].T @ y), q.LOW, q.HIGH)
    cells = defaultdict(list)
    for i, label in zip(known, y):
        cells[int(np.floor((raw[i] - q.LOW) / (q.HIGH - q.LOW) * q.GRID))].append((raw[i], label))
    grid = [(np.mean([a for a, _ in c]), np.mean([b for _, b in c]), len(c)) for _, c in sorted(cells.items())]
    x, means, n = (np.array(v, float) for v in zip(*grid))
    fitted = monotone(x, means, n)
    blocks = [np.flatnonzero(np.isclose(fitted, v)) for v in sorted(set(np.round(fitted, 12)))]
    knots = [np.dot(x[b], n[b]) / n[b].sum() for b in blocks]
    score = 0.999 * np.interp(raw, knots, [fitted[b[0]] for b in blocks]) + 0.001 * (raw - q.LOW) / (q.HIGH - q.LOW)
    found = {r.doc_id: r for r in q.score(docs, labels).collect()}
    assert [found[i].score for i in range(len(texts))] == pytest.approx(score.tolist(), abs=1e-6)
    assert sum((found[i].predicted == 1) == (i % 3 != 0) for i in range(len(texts))) >= 0.95 * len(texts)


def words_of(text):
    return set(re.findall(r"[!#$%&*+/<=>@\[\\\]^_`{|}~-]+|[^\t-\r !-/:-@\[-`{-~]+", text.lower()))


def test_mixing_against_plain_algebra(spark):
    m = mixing
    texts, docs, labels = labelled(spark)
    known = [(words_of(texts[i]), int(i % 3 == 0)) for i in range(0, len(texts), 2)]  # 0 clean, 1 junk
    docs_by = Counter(k for _, k in known)
    frequency = {k: Counter(w for ws, d in known if d == k for w in ws) for k in (0, 1, 2)}
    n, every = len(known), Counter(w for ws, _ in known for w in ws)
    marks = {}
    for w, total in every.items():
        share = total / n
        for k in (0, 1):
            f, size = frequency[k][w], docs_by[k]
            spread = np.sqrt(size * share * (1 - share))
            z = (f - size * share) / spread if spread else 0
            if f / size >= m.LEAST_SHARE and z >= m.LEAST_Z and f / size / share >= m.LEAST_RATIO and total >= m.LEAST_DOCS:
                marks[w] = share
    assert marks

    def posterior(ws):
        logs = []
        for k in (0, 1, 2):
            v = log((docs_by[k] + 1) / (n + 3))
            for w, share in marks.items():
                c = min(max((frequency[k][w] + 2 * share) / (docs_by[k] + 2), 1e-6), 1 - 1e-6)
                v += log(c / share) if w in ws else log((1 - c) / max(1 - share, 1e-6))
            logs.append(v)
        p = np.exp(np.array(logs) - max(logs))
        return p / p.sum()

    p = np.array([posterior(words_of(t)) for t in texts])
    tokens = np.array([len(t.split()) for t in texts], float)
    targets, rate = np.array([0.8, 0.2, 0.0]) * tokens.sum(), np.ones(len(texts))
    least, best, waited, enough = np.inf, rate, 0, m.TOLERANCE * max(1.0, targets.sum())
    while True:
        short = targets - (p * (tokens * rate)[:, None]).sum(axis=0)
        off = np.abs(short).sum()
        waited = 0 if off < least - enough else waited + 1
        if off < least:
            least, best = off, rate
        if np.abs(short).max() <= enough or waited == m.PATIENCE:
            break
        gram = (p * np.where(rate > 0, tokens, 0)[:, None]).T @ p
        rate = np.maximum(0, rate + p @ np.linalg.solve(gram + m.DAMPING * np.trace(gram) / 3 * np.eye(3), short))
    rate = best
    found = {r.doc_id: r for r in m.rates(docs, labels, {"clean": 0.8, "junk": 0.2}).collect()}
    assert [[found[i].p_clean, found[i].p_junk, found[i].p_toxic] for i in range(len(texts))] == [pytest.approx(x.tolist(), abs=1e-9) for x in p]
    assert [found[i].rate for i in range(len(texts))] == pytest.approx(rate.tolist(), rel=1e-6, abs=1e-9)
    assert (p * (tokens * rate)[:, None]).sum(axis=0)[:2] == pytest.approx(targets[:2], rel=1e-3)


def test_marks_on_words_tell_junk(spark):
    """Junk that differs from clean text by the marks on its words alone."""
    rng = np.random.default_rng(2)
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir"]
    rows = [(i, " ".join(w + ("$$$" if i % 4 == 0 else "") for w in rng.choice(words, 30))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    for r in mixing.rates(spark.createDataFrame(rows, "doc_id long, text string"), labels, {"clean": 0.9, "junk": 0.1}).collect():
        assert (r.p_junk > 0.5) == (r.doc_id % 4 == 0) and (r.p_clean > 0.9) == (r.doc_id % 4 != 0)


def test_marks_do_not_hide_words(spark):
    """A word that tells a domain does so with marks on it, too."""
    rng = np.random.default_rng(3)
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir"]
    rows = [(i, " ".join([*rng.choice(words, 30), *(["nettle" + ("###" if i % 24 == 0 else "")] if i % 4 == 0 else [])])) for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240) if i % 24], "doc_id long, quality int, toxic int")
    for r in mixing.rates(spark.createDataFrame(rows, "doc_id long, text string"), labels, {"clean": 0.9, "toxic": 0.1}).collect():
        assert (r.p_toxic > 0.9) == (r.doc_id % 4 == 0)


def test_language_model_end_to_end(spark, monkeypatch):
    """Scores equal those of one plain model over all training texts, Baum-Welch rounds and stop included."""
    texts, docs, _ = labelled(spark, 40)
    monkeypatch.setattr(hmm, "CHUNK_BYTES", 2000)
    train = [i for i in range(len(texts)) if not cases.held(i, 7)]
    tokens = [[*t.lower().encode().split(), b""] for t in texts]
    count = Counter(w for i in train for w in tokens[i])
    symbols = [np.array([hmm.symbol_of(w) for w in ws]) for ws in tokens]
    by_symbol, kinds = Counter(), Counter()
    for w, c in count.items():
        by_symbol[hmm.symbol_of(w)] += c
        kinds[hmm.symbol_of(w)] += 1
    background = (np.array([by_symbol[s] for s in range(hmm.SYMBOLS)]) + 1) / (sum(count.values()) + hmm.SYMBOLS)
    model, before = hmm.first_guess(background), None

    def forward(s):
        a, scales = model.start * model.emit[:, s[0]], []
        alphas = []
        for t, x in enumerate(s):
            if t:
                a = (a @ model.move) * model.emit[:, x]
            scales.append(a.sum())
            a = a / scales[-1]
            alphas.append(a)
        return alphas, scales

    while True:
        total, likely = np.zeros(hmm.STATES + hmm.STATES**2 + hmm.STATES * hmm.SYMBOLS), 0.0
        start, move, emit = total[: hmm.STATES], total[hmm.STATES : hmm.STATES + hmm.STATES**2].reshape(hmm.STATES, -1), total[hmm.STATES + hmm.STATES**2 :].reshape(hmm.STATES, -1)
        for i in train:
            s = symbols[i]
            alphas, scales = forward(s)
            likely += np.log10(scales).sum()
            b = np.ones(hmm.STATES)
            for t in range(len(s) - 1, -1, -1):
                emit[:, s[t]] += alphas[t] * b
                if t == 0:
                    start += alphas[0] * b
                    break
                w = model.emit[:, s[t]] * b / scales[t]
                move += np.outer(alphas[t - 1], w) * model.move
                b = model.move @ w
        model = hmm.estimate(total, background)
        if before is not None and likely - before <= hmm.TOLERANCE * abs(likely):
            break
        before = likely
    expected = []
    for ws, s in zip(tokens, symbols):
        own = sum(np.log10((count[w] + 1) / (by_symbol[x] + (1 if x == hmm.END else kinds[x] + 1))) for w, x in zip(ws, s))
        expected.append(own + np.log10(forward(s)[1]).sum())
    found = {r.doc_id: r.score for r in hmm.score(docs).collect()}
    assert [found[i] for i in range(len(texts))] == pytest.approx(expected, rel=1e-4)


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"{a}{b}" for a in ("lo", "mi", "thér", "ka9", "x@y", "A") for b in ("na.", "ra", "1.2", "", "$", "son")])
    texts = [" ".join(rng.choice(words, 20_000)), "\n".join(" ".join(rng.choice(words, 12)) for _ in range(150_000)), "ü" * (5 << 20)]
    assert max(len(t.encode()) for t in texts) > 9 << 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    ruled = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert [ruled[i].n_words for i in range(3)] == [len(cases.WORD.findall(t)) for t in texts]
    assert {r.doc_id: r.n_words for r in quality_rules.keep_good(docs).join(quality_rules.judge(docs).select("doc_id", "n_words"), "doc_id").collect()} == {i: r.n_words for i, r in ruled.items() if r.kept}
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [found[i].base_sha256 for i in range(3)] == [cases.sha(cases.joined(cases.pii_spans(t))) for t in texts]
    hidden = {r.doc_id: r for r in secrets.digests(docs).collect()}
    assert [hidden[i].base_sha256 for i in range(3)] == [cases.sha(cases.joined(cases.secret_spans(t))) for t in texts]
    prints = {r.doc_id: r.fp for r in simhash.near_duplicates(docs).collect()}
    assert [prints[i] & (2**64 - 1) for i in range(3)] == [simhash.fingerprint(t.encode()) for t in texts]
    stored = {r.doc_id: r for r in media.digests(docs).collect()}
    assert [stored[i].payload_sha256 for i in range(3)] == [cases.sha(media.pad(t.encode())) for t in texts]
    scored = {r.doc_id: r for r in hmm.score(docs).collect()}
    assert [scored[i].n_tokens for i in range(3)] == [len(cases.WORD.findall(t)) + 1 for t in texts]


def plain_votes(f):
    """The nine votes of a text, from its counts."""
    share = lambda a, b: a / b if b else 0.0

    def band(value, good, bad, ready):
        return 0 if not ready else -1 if value >= bad else 1 if value <= good else 0

    n, some = f["n_words"], f["n_words"] >= 10
    mean = share(f["word_chars"], n)
    return [
        band(share(f["n_symbols"], n), 0.1, 0.3, some), band(share(f["n_runs"], n), 0.03, 0.15, some), band(share(f["n_odd"], f["n_bytes"]), 0.06, 0.09, some),
        band(share(f["n_upper"], f["n_upper"] + f["n_lower"]), 0.15, 0.4, some), band(share(f["n_repeat_words"], n), 0.1, 0.3, some), band(share(f["n_dup_lines"], f["n_lines"]), 0.1, 0.3, f["n_lines"] >= 3),
        band(share(f["n_marks"], n), 0.05, 0.2, some), -1 if some and (mean < 2.5 or mean > 14) else 1 if some and 3 <= mean <= 11 else 0, band(1 - share(f["n_distinct"], n), 0.7, 0.9, n >= 100),
    ]


def test_quality_posterior_is_plain_expectation_maximisation(spark):
    """Document by document, in numpy: the posterior and the verdict of every text."""
    docs = cases.documents(spark)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    counts = [dict(zip(quality_rules.FEATURES, quality_rules.count_features(None if t is None else t.encode()))) for _, t in given]
    votes = np.array([plain_votes(f) for f in counts])
    p = np.array([(0.95, 0.2, 0.02)[min(2, int((v == -1).sum()))] for v in votes])
    for _ in range(200):
        prior = min(0.98, max(0.05, (p.sum() + 7) / (len(p) + 10)))
        good = np.array([[0.1 + p[votes[:, j] == -1].sum(), 1 + p[votes[:, j] == 0].sum(), 2 + p[votes[:, j] == 1].sum()] for j in range(9)])
        bad = np.array([[2 + (1 - p)[votes[:, j] == -1].sum(), 1 + (1 - p)[votes[:, j] == 0].sum(), 1 + (1 - p)[votes[:, j] == 1].sum()] for j in range(9)])
        good, bad = good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True)
        turned = bad[:, 0] < good[:, 0]
        good[turned] = bad[turned] = (good[turned] + bad[turned]) / 2
        likely = lambda chances: np.prod([chances[j][votes[:, j] + 1] for j in range(9)], axis=0)
        new = prior * likely(good) / (prior * likely(good) + (1 - prior) * likely(bad))
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
    found = sorted(((r.doc_id, round(r.posterior, 6), r.kept) for r in quality_rules.judge(docs).collect()), key=repr)
    fails = [f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"] for f in counts]
    expected = sorted(((i, round(float(x), 6), bool(not bad_ and x >= 0.5)) for (i, _), x, bad_ in zip(given, p, fails)), key=repr)
    assert found == expected and {k for *_, k in found} == {True, False}
