"""Each operator against a plain re-statement of its contract, on awkward documents."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import product
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("strata.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm import cases  # noqa: E402

from strata.llm import bpe, components, hmm, media, mixing, pii, quality_classifier, quality_rules, secrets, simhash, tokenfiles  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def given(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


# --- operator 1 ----------------------------------------------------------------------


def labels_of(spark, given):
    rows = [(i, int("$$$" not in (t or "") and "!!" not in (t or "")), 0) for i, t in given if i is not None and i % 5]
    return spark.createDataFrame([*rows, rows[0], (None, 1, 0), (3, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_scores(spark, docs, given):
    labels = labels_of(spark, given)
    found = quality_classifier.score(docs, labels).collect()
    assert len(found) == len(given)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert Counter((r.doc_id, r.held_out) for r in found) == Counter((i, cases.held(i, 4)) for i, _ in given)
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert cases.as_rows(quality_classifier.score(docs, flipped), "doc_id", "score") == cases.as_rows(quality_classifier.score(docs, labels), "doc_id", "score")


def test_quality_without_labels_or_documents(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(cases.empty(spark), none).count() == 0


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    x, y, w = np.arange(6.0), rng.random(6), rng.integers(1, 4, 6).astype(float)
    _, values = quality_classifier.isotonic(x, y, w)
    knots, _ = quality_classifier.isotonic(x, y, w)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    blocks = [(a, b) for a in range(6) for b in range(a + 1, 7)]
    assert all(any(abs(np.average(y[a:b], weights=w[a:b]) - v) < 1e-12 for a, b in blocks) for v in values)


# --- operators 2 and 6 ---------------------------------------------------------------


def test_bpe_round_trip(spark, docs, given, library):
    expected = []
    for i, t in given:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), cases.sha(",".join(map(str, ids))), cases.sha(library.decode(ids, skip_special_tokens=False))))
    assert cases.as_rows(bpe.round_trip(docs, TOKENIZER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert bpe.round_trip(cases.empty(spark), TOKENIZER).count() == 0
    back = docs.select("text", bpe.decode_column(bpe.encode_column("text", TOKENIZER), TOKENIZER).alias("back"))
    assert all((r.text or "") == r.back for r in back.collect())


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 3000, "é" * 900, "the" * 200, " " * 700 + "x", "1" * 129])
def test_bpe_of_long_words(word, library):
    assert bpe.ByteBPE(TOKENIZER).encode(word) == library.encode(word, add_special_tokens=False).ids


def test_scan_and_heap_agree():
    b, rng = bpe.ByteBPE(TOKENIZER), np.random.default_rng(1)
    for _ in range(300):
        word = bytes(rng.choice(list(b"theing aou"), rng.integers(0, 60)).tolist())
        assert b._scan(word) == b._heap(word)


def test_new_characters_follow_the_library(library):
    b, e = bpe.ByteBPE(TOKENIZER), tokenfiles.Encoder(TOKENIZER)
    for c in (0x1C89, 0xA7CB, 0x1E5F6, 0x558, 0x88F, 0x323B0, 0x1C, 0x85, 0x3000, 0x180E):
        text = f"a{chr(c)}b 1{chr(c)}{chr(c)} .{chr(c)} {chr(c)}"
        ids = library.encode(text, add_special_tokens=False).ids
        assert b.encode(text) == ids and e.encode(text).tolist() == ids


@pytest.mark.parametrize("top", [1, 16, 59, 64])
def test_simple8b(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 59, 60, 61, 500):
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) >> rng.integers(64 - top, 64, n).astype(np.uint64)
        assert (tokenfiles.unpack(tokenfiles.pack(ids), n) == ids).all() if n else len(tokenfiles.pack(ids)) == 0


def test_token_files(spark, docs, given, library):
    manifest = tokenfiles.write_token_files(docs, TOKENIZER)
    found = tokenfiles.read_token_files(manifest).collect()
    at, expected = 0, []
    for i, t in sorted(given, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(cases.empty(spark), TOKENIZER)).count() == 0


def test_token_files_roll(spark, docs, monkeypatch):
    whole = sorted(map(tuple, tokenfiles.read_token_files(tokenfiles.write_token_files(docs, TOKENIZER)).collect()), key=lambda r: r[1])
    monkeypatch.setattr(tokenfiles, "ROLL", 7)
    manifest = tokenfiles.write_token_files(docs, TOKENIZER)
    assert manifest.where("docs > 7").count() == 0 and manifest.count() > 7
    assert sorted(map(tuple, tokenfiles.read_token_files(manifest).collect()), key=lambda r: r[1]) == whole


# --- operator 3 ----------------------------------------------------------------------


def test_rule_counts(spark, docs, given):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules.judge(docs)
    assert cases.as_rows(judged, *names) == sorted(((i, *cases.rule_counts(t)) for i, t in given), key=repr)
    for r in judged.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    assert quality_rules.judge(cases.empty(spark)).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert cases.as_rows(kept, "doc_id") == cases.as_rows(judged.where("kept"), "doc_id")


def test_expectation_maximisation_finds_the_rare_bad_ones():
    good, bad = (1, 1, 1, 1), (-1, -1, -1, 1)
    model = quality_rules.expectation_maximisation([(good, 900), (bad, 60), ((1, 1, 1, 0), 50), ((-1, 1, 1, 1), 5)])
    weights = model.weights()
    odds = lambda v: model.odds() + sum(w[x + 1] for x, w in zip(v, weights))
    assert odds(good) > 0 > odds(bad)
    assert quality_rules.expectation_maximisation([]).prior > 0.5


# --- operator 4 ----------------------------------------------------------------------


def test_pii_base(spark, docs, given):
    found = pii.find(docs)
    expected = []
    for i, t in given:
        spans = cases.pii_spans(t)
        n = Counter(k for k, *_ in spans)
        expected.append((i, *(n[k] for k in pii.KINDS), cases.sha(cases.joined(spans))))
    assert cases.as_rows(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected, key=repr)
    assert pii.find(cases.empty(spark)).count() == 0


def test_pii_patterns_discover(spark):
    rows = [(i, f"Some words then account number: {1111_2222_3333_4444 + i * 7:016d} follow. Reach me at user{i}@mail.example.com today") for i in range(300)]
    rows += [(1000, "Text with account number: ZX-99887766 in it"), (1001, "reach me at id#4455667788 please"), (1002, "version 20240101 of nothing")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1001] == "context:12:25"
    assert found[1002] == ""


def test_pii_native_plan(spark, docs):
    plan = pii.find(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_redaction(spark, docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    (row,) = out.where("text like 'mail %'").collect()
    assert row.text.startswith("mail [EMAIL], x@[EMAIL] and [IP] or 1.2.3.256 ")
    assert out.where("text is null").count() == docs.where("text is null").count()


# --- operator 5 ----------------------------------------------------------------------


def print_of(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, radius=2):
    """Smallest doc_id reachable from each row by links."""
    n, parent = len(prints), list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in product(range(n), repeat=2):
        if i < j and (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        ids = least.setdefault(root(i), [])
        if prints[i][0] is not None:
            ids.append(prints[i][0])
    return [(prints[i][0], f"{prints[i][1]:016x}", min(least[root(i)], default=None)) for i in range(n)]


def test_simhash(spark, docs, given):
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_column(F.col("fp")).alias("fingerprint"), "component_id")
    expected = groups_of([(i, print_of(t)) for i, t in given])
    assert cases.as_rows(found, "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({c for _, _, c in expected}, key=repr)


def test_links_of_many_neighbours(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    prints = {b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(12)} | set(base)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = components.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    rows = sorted(prints)
    expected = groups_of([(i, p) for i, p in enumerate(rows)])
    classes = {}
    for (i, _, c), p in zip(expected, rows):
        classes.setdefault(c, set()).add(p)
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(int(np.int64(r.node).astype(np.uint64)))
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    found = {r.node: r.root for r in components.components(e).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- operator 7 ----------------------------------------------------------------------


def test_secrets(spark, docs, given):
    expected = []
    for i, t in given:
        spans = cases.secret_spans(t)
        n = Counter(k for k, *_ in spans)
        expected.append((i, n["assign"], n["access"], n["hex"], cases.sha(cases.joined(spans))))
    assert cases.as_rows(secrets.digests(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(expected, key=repr)
    assert secrets.digests(cases.empty(spark)).count() == 0


def test_checksums():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good, bad = f"ghp_{body}{secrets.crc_base62(body)}", f"ghp_{body}AAAAAA"
    scan = secrets.Scanner().scan
    assert scan(f"x {good} y") == [("checked", 2, 42, True)]
    assert scan(f"x {bad} y") == []
    assert scan(f"token={good}") == [("assign", 0, 46, True), ("checked", 6, 46, True)]
    assert [f[0] for f in scan("k 5HueCGU8rMjxEXxiPuD5BDku4MkFqeZyd4dZ1jvhTVqvbTLvyTJ .")] == ["wif"]
    assert secrets._mask("token=abcdef, x", scan("token=abcdef, x")) == "[assign], x"


# --- operator 8 ----------------------------------------------------------------------


def test_media(spark, docs, given):
    found = media.digests(docs).collect()
    expected = []
    for i, t in given:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        expected.append((i, len(raw), len(padded), cases.sha(padded), zlib.crc32(padded[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found), key=repr) == sorted(expected, key=repr)
    same = {}
    for r in found:
        assert same.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.digests(cases.empty(spark)).count() == 0
    thumbs = media.thumbnails(media.to_media(docs)).collect()
    assert len(thumbs) == len(given) and all(len(r.thumb) == r.thumb_width * r.thumb_height for r in thumbs)
    broken = spark.createDataFrame([(1, bytearray(b"\xff\xd8junk")), (2, None)], "doc_id long, media binary")
    assert [r.width for r in media.thumbnails(broken).collect()] == [None, None]


def coded(table, pairs):
    """Bits of (symbol, bits, width) by a Huffman specification."""
    codes, code, at = {}, 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            codes[table[at]] = f"{code:0{size}b}"
            code, at = code + 1, at + 1
        code <<= 1
    return "".join(codes[s] + (f"{b:0{w}b}" if w else "") for s, b, w in pairs)


def test_jpeg_with_runs_colour_and_no_restarts():
    """A 16x16 picture of 2x2 sampled luminance and two chroma planes, in one interval."""
    dc = bytes([0, 3, 1, *[0] * 13, 0, 2, 3, 4])
    ac = bytes([0, 2, 2, 1, *[0] * 12, 0x00, 0x01, 0x12, 0xF0, 0x02])
    raw = lambda v: (v if v > 0 else v + (1 << abs(v).bit_length()) - 1, abs(v).bit_length())
    blocks, bits, last = [], "", {0: 0, 1: 0, 2: 0}
    for comp, value, tail in [(0, 10, [(0, 1)]), (0, -3, []), (0, 5, [(16, 1)]), (0, 5, []), (1, -2, []), (2, 9, [])]:
        diff = value - last[comp]
        last[comp] = value
        size = abs(diff).bit_length()
        bits += coded(dc, [(size, raw(diff)[0] if size else 0, size)])
        row = np.zeros(64, int)
        row[0] = value
        at = 1
        for run, v in tail:
            bits += coded(ac, [(0xF0, 0, 0)] if run == 16 else []) + coded(ac, [(0x01, 1, 1)])
            at += run
            row[at] = v
            at += 1
        bits += coded(ac, [(0x00, 0, 0)])
        blocks.append(row)
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    frame = b"\x08\x00\x10\x00\x10\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    jpeg = b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + seg(0xC0, frame) + seg(0xC4, bytes([0]) + dc + bytes([0x10]) + ac)
    jpeg += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    (scan,) = media.decode_scans([media.parse(jpeg)])
    assert [b[0].tolist() for b in scan] == [b.tolist() for b in blocks]
    assert media.decode([jpeg])[0][2].tolist() == [[138, 125], [133, 133]]


def test_zigzag():
    assert media.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert sorted(media.zigzag().tolist()) == list(range(64))


# --- operator 9 ----------------------------------------------------------------------


def small_model():
    rng = np.random.default_rng(4)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    return hmm.Hmm(norm(rng.random(hmm.STATES)), norm(rng.random((hmm.STATES, hmm.STATES))), norm(rng.random((hmm.STATES, hmm.SYMBOLS))))


def test_forward_and_counts_against_all_paths():
    model, states = small_model(), range(hmm.STATES)
    sequences = [np.array([5, 9, 5]), np.array([hmm.END]), np.array([1, 2])]
    total, likely = np.zeros(hmm.STATES + hmm.STATES**2 + hmm.STATES * hmm.SYMBOLS), []
    for s in sequences:
        mass, counts = 0.0, np.zeros_like(total)
        for path in product(states, repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[b, x]
            mass += p
            counts[path[0]] += p
            for a, b in zip(path, path[1:]):
                counts[hmm.STATES + a * hmm.STATES + b] += p
            for a, x in zip(path, s):
                counts[hmm.STATES + hmm.STATES**2 + a * hmm.SYMBOLS + x] += p
        total += counts / mass
        likely.append(log10(mass))
    batch = hmm.Batch(sequences)
    assert np.allclose(batch.likelihoods(model), likely)
    assert np.allclose(batch.expected(model), total)


def test_word_chances_sum_to_one():
    assert hmm.symbol_of(b"") == hmm.END and max(hmm.symbol_of(w) for w in (b"a", b"abc", b"abcd", b"\xff" * 9)) < hmm.END


@pytest.mark.parametrize(("fan", "buckets"), [(256, None), (2, None), (3, 1)])
def test_language_model(spark, docs, given, monkeypatch, fan, buckets):
    monkeypatch.setattr(hmm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(hmm, "FAN", fan)
    if buckets:
        monkeypatch.setattr(hmm, "buckets_for", lambda _: buckets)
    found = hmm.score(docs).collect()
    tokens = lambda t: [*bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split(), b""]
    c = Counter(w for i, t in given if not cases.held(i, 7) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = []
    for i, t in given:
        ws = tokens(t)
        expected.append((i, cases.held(i, 7), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert hmm.score(cases.empty(spark)).count() == 0


def test_long_text_in_segments(monkeypatch):
    model, text = small_model(), np.random.default_rng(4).integers(0, hmm.SYMBOLS, 103)
    whole = hmm.Batch([text])
    expected, likely = whole.expected_and_likelihood(model)
    assert likely == pytest.approx(whole.likelihoods(model)[0])
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 10)
    parts = hmm.Batch([text])
    assert max(e - b for b, e in parts.spans()) == 10
    assert np.allclose(parts.likelihoods(model), likely) and np.allclose(parts.expected(model), expected)
    mixed = [text[:23], text[23:40], text[40:41]]
    assert np.allclose(hmm.Batch(mixed).expected(model), sum(hmm.Batch([s]).expected(model) for s in mixed))


def test_every_round_learns_from_all_texts(spark, monkeypatch):
    rows = [(i, "a few short words" if i % 3 else "one long document " * 500) for i in range(60)]
    docs, seen, estimate, counted = spark.createDataFrame(rows, "doc_id long, text string"), [], hmm.estimate, hmm.expected_counts
    likely, all_tokens = [], sum(len(t.split()) + 1 for i, t in rows if not cases.held(i, 7))
    monkeypatch.setattr(hmm, "estimate", lambda counts, background: (seen.append(counts[-hmm.STATES * hmm.SYMBOLS :].sum()), estimate(counts, background))[1])
    monkeypatch.setattr(hmm, "expected_counts", lambda *given: (found := counted(*given), likely.append(found[1]))[0])
    hmm.score(docs)
    assert seen == pytest.approx([all_tokens] * len(seen))
    gains = [(b - a) / abs(b) for a, b in zip(likely, likely[1:])]
    assert all(g > hmm.TOLERANCE for g in gains[:-1]) and gains[-1] <= hmm.TOLERANCE


# --- operator 10 ---------------------------------------------------------------------


def test_word_buckets():
    texts = ["The idiot, the IDIOT (idiot)", None, "", "x", "averyverylongword averyverylongwore\tb", "ab" * 5000]
    counts, buckets = mixing.word_buckets(pa.array(texts))
    assert counts.tolist() == [5, 0, 0, 1, 3, 1]
    assert [len(b) for b in buckets] == [2, 0, 0, 1, 3, 1]
    again = mixing.word_buckets(pa.array(["skip", *texts]).slice(1))
    assert again[0].tolist() == counts.tolist() and all((a == b).all() for a, b in zip(again[1], buckets))


def test_words_differ_in_the_middle():
    long = "abcdefgh" + "x" * 20 + "ijklmnop"
    texts = [long, long.replace("xxxx", "xxyx", 1), long.replace("x", "y"), f"{long} {long[:12]}q{long[13:]}"]
    _, buckets = mixing.word_buckets(pa.array(texts))
    assert len({b for row in buckets for b in row.tolist()}) == 4 and [len(b) for b in buckets] == [1, 1, 1, 2]
    assert all(buckets[0][0] in mixing.word_buckets(pa.array([f"{'so ' * n}{long}"]))[1][0] for n in range(30))


def test_unreachable_targets_show(spark):
    docs = spark.createDataFrame([(i, "some fine words here") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int")
    short = mixing.rates(docs, labels, {"clean": 0.5, "toxic": 0.5}).select("short_clean", "short_junk", "short_toxic").distinct().collect()
    assert len(short) == 1 and short[0].short_toxic > 50 and abs(sum(short[0])) < 120


def test_rates_meet_targets(spark):
    rows = [(i, ("clown trash " if i % 4 == 0 else "fine words ") + "the same text here for all " * (1 + i % 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    out = mixing.rates(docs, labels, {"clean": 0.9, "toxic": 0.1}).cache()
    got = out.agg(*(F.sum(F.col(f"p_{d}") * F.col("n_tokens") * F.col("rate")) for d in ("clean", "toxic")), F.sum("n_tokens"), F.min("rate")).first()
    assert got[0] == pytest.approx(0.9 * got[2], rel=0.02) and got[1] == pytest.approx(0.1 * got[2], rel=0.1)
    assert got[3] >= 0
    for r in out.collect():
        assert (r.p_toxic > 0.5) == (r.doc_id % 4 == 0)
        assert r.copies in (int(r.rate), int(r.rate) + 1)


def test_mixing_awkward_documents(spark, docs, given):
    labels = labels_of(spark, given)
    assert mixing.rates(docs, labels, {"clean": 1.0}).count() == len(given)
    assert mixing.rates(cases.empty(spark), labels, {"clean": 1.0}).count() == 0
    assert mixing.thin(docs, labels, {"clean": 1.0}).columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.thin(docs, none, {}).count() == len(given)


def test_thin_meets_targets(spark):
    kinds = [("fine words ", 1), ("$$ click here ", 0)]
    rows = [(i, kinds[i % 2][0] + "the same text here for all " * (1 + i % 3)) for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, kinds[i % 2][1], 0) for i in range(0, 20000, 3)], "doc_id long, quality int, toxic int")
    for factor in (0.3, 0.5, 0.7):
        kept = mixing.thin(docs, labels, {"junk": factor}).collect()
        for k, share in ((0, 1.0), (1, factor)):
            tokens = lambda found: sum(len(t.split()) for i, t in found if i % 2 == k)
            assert tokens(kept) == pytest.approx(share * tokens(rows), rel=0.05)


# --- operator 5 in the pipeline ------------------------------------------------------


def test_keep_one_each_of_every_group(spark):
    one, two = "the first text has some words of its own " * 5, "another document says quite other things here " * 5
    docs = spark.createDataFrame([(1, one), (2, one), (1, two), (3, two)], "doc_id long, text string")
    assert cases.as_rows(simhash.keep_one_each(docs), "doc_id", "text") == sorted([(1, one), (1, two)], key=repr)
    base = " ".join(f"word{i}" for i in range(60))
    nameless = spark.createDataFrame([(None, f"{base} end{i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    prints = {r.fp for r in simhash.near_duplicates(nameless).collect()}
    groups = []
    for fp in prints:
        near = [g for g in groups if any(((fp ^ other) & (2**64 - 1)).bit_count() <= 2 for other in g)]
        groups = [g for g in groups if g not in near] + [{fp}.union(*near)]
    assert len(groups) < len(prints)
    assert simhash.keep_one_each(nameless).count() == len(groups)


def test_one_place_of_many_tiles(spark, monkeypatch):
    """Fingerprints of one place: balanced pairs of tiles, and the components of all pairs."""
    monkeypatch.setattr(simhash, "TILE", 20)
    rng = np.random.default_rng(6)
    prints = set()
    while len(prints) < 1200:
        p = sum(int(sum(1 << int(b) for b in rng.choice(16, 8, replace=False))) << (16 * k) for k in range(4))
        prints |= {p, p ^ 0b11 if bin(p & 3).count("1") == 1 else p}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    got = {}
    for r in components.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect():
        got.setdefault(r.root, set()).add(int(np.int64(r.node).astype(np.uint64)))
    rows, classes = sorted(prints), {}
    for (_, _, c), p in zip(groups_of(list(enumerate(rows))), rows):
        classes.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_each_tile_gets_half_the_pairs(spark):
    parts = spark.range(64)
    both = parts.select(F.col("id").alias("a")).join(parts.select(F.col("id").alias("b")), simhash._one_of_two(F.col("a"), F.col("b")))
    rows = [(r.a, r.b) for r in both.collect()]
    assert len({frozenset(r) for r in rows}) == len(rows) == 64 * 65 // 2
    assert set(Counter(b for _, b in rows).values()) <= {32, 33}
