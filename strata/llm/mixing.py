"""Mixing sources to target weights by soft membership (operator 10).

Rows of the labelled table fall into domains; a naive Bayes classifier on hashed
words, cut to those that mark a domain, predicts each document's posteriors.  Rates r >= 0 are then fitted so that the
expected tokens of each domain, sum(tokens * posterior * r), match the targets:
projected-gradient least squares from r = 1, each step's gradient scaled by the
small Gram matrix of the documents still at work.  A step is one aggregation of
a few sums; the rates are an expression of the steps so far and travel nowhere.

Null text counts as empty and has no tokens; it takes part with rate and all.
Labels repeated for a doc_id count once, by their largest values; a null doc_id
has none.  Steps go on until the targets are met or some steps have brought the totals no
nearer to them; what then still lacks (a domain that no document belongs to has nothing
to give) stands in the result by domain.  Words of any length count with all their bytes.  Repeated rows are documents each; rows of one doc_id draw
alike.  An empty table gives an empty result.  Columns besides doc_id and text
play no part and are kept by ``thin``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import release_memory, released
from strata.storage import materialize

DOMAINS = ("clean", "junk", "toxic")
BUCKETS = 1 << 18
LEAST_DOCS = 5
LEAST_Z = 5.0
LEAST_SHARE = 0.1
LEAST_RATIO = 2.0
PATIENCE = 3  # steps that may bring the totals no nearer to their targets
DAMPING = 1e-3
TOLERANCE = 1e-4  # of all target tokens
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.where(_SPACE, 0, 1).astype(np.uint8)  # 1: letters, 2: marks that tell junk, 0: what stands between
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_KIND[[ord(c) for c in ",.;:?\"'()"]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def domain_of(quality: Column, toxic: Column) -> Column:
    """Index in DOMAINS; null where the label does not say."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def _starts(letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where runs of letters begin; ``first`` marks documents' first bytes, which runs never cross."""
    before = np.empty_like(letters)
    before[0] = False
    before[1:] = letters[:-1]
    return letters & (~before | first)


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of some documents at a time."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []  # of the base and of its inverse, as far as any slice has needed


def _run_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of all bytes of each run: a polynomial modulo 2 ** 64, by sums over the whole slice."""
    if not _powers or len(_powers[0]) < len(data):
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(len(data), 2 * SLICE_BYTES), base, np.uint64)
            steps[:1] = 1
            _powers.append(np.multiply.accumulate(steps))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(data)], out=sums[1:])
    mixed = (sums[begin + size] - sums[begin]) * _powers[1][begin] ^ size.astype(np.uint64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text by white space, and the distinct buckets of its words shorn of marks and of its runs of rarer marks."""
    counts, buckets = [], []
    for data, offsets in _slices(texts):
        many = len(offsets) - 1
        if not len(data):
            counts.append(np.zeros(many, np.int64))
            buckets += [np.empty(0, np.uint32)] * many
            continue
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        first = first[:-1]
        words = np.flatnonzero(_starts(~_SPACE[data], first))
        counts.append(np.diff(np.searchsorted(words, offsets)))
        low, kind = _LOWER[data], _KIND[data]
        change = first.copy()
        change[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(change)
        size, own = np.diff(begin, append=len(data)), kind[begin] > 0
        begin, size = begin[own], size[own]
        mixed = _run_hashes(low, begin, size)
        owner = np.searchsorted(offsets, begin, "right") - 1
        keys = np.unique(owner * BUCKETS + (mixed >> np.uint64(46)).astype(np.int64))
        cut = np.searchsorted(keys, np.arange(1, many) * BUCKETS)
        buckets += np.split((keys % BUCKETS).astype(np.uint32), cut)
    return (np.concatenate(counts) if counts else np.zeros(0, np.int64)), buckets


@dataclass(frozen=True)
class Classifier:
    base: np.ndarray  # (domains): log prior and what all absent marks say
    weights: np.ndarray  # (BUCKETS, domains): what a word's presence adds

    def posteriors(self, buckets: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in buckets], np.int64)
        logs = np.tile(self.base, (len(buckets), 1))
        if sizes.sum():
            flat, owner = np.concatenate(buckets), np.repeat(np.arange(len(buckets)), sizes)
            for k in range(len(self.base)):
                logs[:, k] += np.bincount(owner, self.weights[flat, k], len(buckets))
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(axis=1, keepdims=True)


def estimate(frequency: np.ndarray, docs: np.ndarray) -> Classifier:
    """Classifier from document frequencies (domains, BUCKETS) and documents by domain.

    A domain's marks are words that enough of its documents have, and at least
    LEAST_RATIO times as often as documents at large; all else is left out, so
    neither short texts nor groups of copies lean to a domain by chance.
    """
    total, n = frequency.sum(axis=0), docs.sum()
    share, some = total / max(n, 1), np.maximum(docs, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (frequency - docs[:, None] * share) / np.sqrt(docs[:, None] * share * (1 - share))
        ratio = frequency / some / share
    mark = (frequency / some >= LEAST_SHARE) & (np.nan_to_num(z, posinf=0) >= LEAST_Z) & (np.nan_to_num(ratio, posinf=0) >= LEAST_RATIO)
    informative = mark.any(axis=0) & (total >= LEAST_DOCS)
    # Shrunken towards the corpus' share, more so for domains with few documents.
    chance = np.clip((frequency + 2 * share) / (docs[:, None] + 2), 1e-6, 1 - 1e-6)
    present = np.where(informative, np.log(chance / np.clip(share, 1e-6, 1)), 0.0)
    absent = np.where(informative, np.log((1 - chance) / np.clip(1 - share, 1e-6, 1)), 0.0)
    prior = np.log((docs + 1) / (n + len(docs)))
    return Classifier(prior + absent.sum(axis=1), np.ascontiguousarray((present - absent).T))


def featurise(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, buckets) of every document, written once; texts are not read again."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, buckets = word_buckets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([b.tobytes() for b in buckets], pa.binary())], ["doc_id", "n_tokens", "buckets"])
            release_memory()

    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, buckets binary"), "word-buckets")


def fit_classifier(features: DataFrame, labels: DataFrame) -> Classifier:
    """Document frequencies by domain over all labelled documents, counted in partitions and summed by bucket.

    One row for each bucket comes to the driver, however large the corpus.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(DOMAINS), BUCKETS + 1), np.int64)
        for batch in batches:
            domain = batch.column(1).to_numpy(zero_copy_only=False)
            buckets = batch.column(0).to_pylist()
            for k in range(len(DOMAINS)):
                own = [np.frombuffer(buckets[i], np.uint32) for i in np.flatnonzero(domain == k)]
                total[k, BUCKETS] += len(own)
                if own:
                    total[k, :BUCKETS] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[k, some]) for k in range(len(DOMAINS)))], ["bucket", *DOMAINS])

    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.select("labelled", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null")
    # Labels grow with the corpus: the join is a sort-merge one at every size.
    rows = features.join(known.hint("merge"), F.col("doc_id") == F.col("labelled")).select("buckets", "domain")
    counted = rows.mapInArrow(part, "bucket bigint, " + ", ".join(f"{d} bigint" for d in DOMAINS))
    sums = counted.groupBy("bucket").agg(*(F.sum(d).alias(d) for d in DOMAINS))
    # Words of few documents mark no domain.
    sums = sums.where((F.col("bucket") == BUCKETS) | (sum(map(F.col, DOMAINS), F.lit(0)) >= LEAST_DOCS)).toArrow()
    total = np.zeros((len(DOMAINS), BUCKETS + 1), np.int64)
    for k, d in enumerate(DOMAINS):
        total[k, sums.column("bucket").to_numpy()] = sums.column(d).to_numpy()
    return estimate(total[:, :BUCKETS], total[:, BUCKETS])


def _posterior_struct() -> str:
    return "struct<" + ",".join(f"{d}:double" for d in DOMAINS) + ",n_tokens:bigint>"


def _as_struct(p: np.ndarray, counts: np.ndarray) -> pa.Array:
    fields = [pa.field(d, pa.float64()) for d in DOMAINS] + [pa.field("n_tokens", pa.int64())]
    return pa.StructArray.from_arrays([*(pa.array(p[:, k]) for k in range(len(DOMAINS))), pa.array(counts, pa.int64())], fields=fields)


def posteriors_of_buckets(buckets: str, n_tokens: str, model: Classifier) -> Column:
    @F.arrow_udf(_posterior_struct())
    @released
    def run(rows: pa.Array, counts: pa.Array) -> pa.Array:
        return _as_struct(model.posteriors([np.frombuffer(b, np.uint32) for b in rows.to_pylist()]), counts.to_numpy())

    return run(buckets, n_tokens)


def posteriors_of_text(text: str, model: Classifier) -> Column:
    @F.arrow_udf(_posterior_struct())
    @released
    def run(texts: pa.Array) -> pa.Array:
        counts, buckets = word_buckets(texts)
        return _as_struct(model.posteriors(buckets), counts)

    return run(text)


@dataclass(frozen=True)
class Mix:
    """Steps of the fit, each a number by domain; the totals they reach and the targets."""

    steps: tuple[tuple[float, ...], ...]
    totals: tuple[float, ...]
    targets: tuple[float, ...]

    def rate(self, m: Column) -> Column:
        """Rate of a document, for a struct of posteriors."""
        out = F.lit(1.0)
        for step in self.steps:
            out = F.greatest(F.lit(0.0), sum((m[d] * F.lit(s) for d, s in zip(DOMAINS, step)), out))
        return out


def fit_rates(members: DataFrame, weights: dict[str, float] | None = None, factors: dict[str, float] | None = None, tokens: float | None = None) -> Mix:
    """Rates for (m: struct of posteriors and n_tokens) rows.

    Targets are ``weights`` (shares of ``tokens``, by default as many as there
    are now) or ``factors`` of what each domain has now.
    """
    k, m, steps, targets, best, waited = len(DOMAINS), F.col("m"), [], None, None, 0
    while True:
        mix = Mix(tuple(steps), (), ())
        rate = mix.rate(m)
        at_work = F.when(F.col("rate") > 0, F.col("m")["n_tokens"]).otherwise(0)
        sums = [F.sum(m[d] * m["n_tokens"] * F.col("rate")) for d in DOMAINS]
        sums += [F.sum(m[a] * m[b] * at_work) for a in DOMAINS for b in DOMAINS]
        found = np.array([x or 0.0 for x in members.select("m", rate.alias("rate")).agg(*sums).first()])
        totals, gram = found[:k], found[k:].reshape(k, k)
        if targets is None:
            if factors is not None:
                targets = np.array([factors.get(d, 1.0) for d in DOMAINS]) * totals
            else:
                share = np.array([weights.get(d, 0.0) for d in DOMAINS])
                targets = share / share.sum() * (totals.sum() if tokens is None else tokens)
        short, enough = targets - totals, TOLERANCE * max(1.0, targets.sum())
        waited = 0 if best is None or np.abs(short).sum() < np.abs(best[1]).sum() - enough else waited + 1
        if best is None or np.abs(short).sum() < np.abs(best[1]).sum():
            best = tuple(steps), short
        if np.abs(short).max() <= enough or waited == PATIENCE:
            break
        # The damping keeps a domain that hardly any document belongs to from driving all rates.
        damped = gram + DAMPING * max(np.trace(gram) / k, 1e-300) * np.eye(k)
        steps.append(tuple(float(x) for x in np.linalg.solve(damped, short)))
    return Mix(best[0], tuple(map(float, targets - best[1])), tuple(map(float, targets)))


def _chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that a document keeps."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], tokens: float | None = None, seed: int = 5) -> DataFrame:
    """doc_id, n_tokens, p_ of each domain, rate, copies (the rate rounded by a document's own chance) and short_ of each domain.

    ``short_`` is the same in all rows: the tokens by which the fitted rates miss that domain's target.
    """
    features = featurise(docs)
    model = fit_classifier(features, labels)
    members = materialize(features.select("doc_id", posteriors_of_buckets("buckets", "n_tokens", model).alias("m")), "posteriors")
    mix, m = fit_rates(members, weights=weights, tokens=tokens), F.col("m")
    out = members.select("doc_id", m["n_tokens"].alias("n_tokens"), *(m[d].alias(f"p_{d}") for d in DOMAINS), mix.rate(m).alias("rate"))
    short = {f"short_{d}": F.lit(t - have) for d, have, t in zip(DOMAINS, mix.totals, mix.targets)}
    return out.withColumns({"copies": F.floor(F.col("rate") + _chance(F.col("doc_id"), seed)), **short})


def thin(docs: DataFrame, labels: DataFrame, factors: dict[str, float], seed: int = 5) -> DataFrame:
    """``docs`` without the rows that the rates leave out: a row stays with its rate as chance, for sure from 1 on."""
    features = featurise(docs)
    model = fit_classifier(features, labels)
    members = materialize(features.select(posteriors_of_buckets("buckets", "n_tokens", model).alias("m")), "posteriors")
    mix, names, member = fit_rates(members, factors=factors), docs.columns, "_strata_member"
    marked = docs.withColumn(member, posteriors_of_text("text", model))
    rate = mix.rate(F.col(member))
    return marked.where(_chance(F.col("doc_id"), seed) < rate).select(*names)
