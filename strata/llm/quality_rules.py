"""Quality rules under weak supervision (operator 3).

Each rule reads a few counts of a text and votes good (1), bad (-1) or abstains
(0).  Expectation-maximisation over the table of vote patterns (at most
3^rules rows, whatever the corpus) estimates each rule's accuracy on good and on
bad texts and how common good texts are; a text is kept if the posterior
probability that it is good reaches one half.  A rule that nearly always votes
good thus says little by doing so, and much by voting bad.  Counts are taken
over all documents.

Null and empty texts have no words and fail the base.  Repeated rows are texts each, in
the counts as in the result; equal texts get equal verdicts, whatever their doc_id, and a null
doc_id stays null.  A posterior of exactly one half is kept.  Very long texts are counted whole, in
time linear in their bytes but for the sorting of their words.  An empty table gives an empty
result and the pseudo-counts' model.  Input columns other than doc_id and text, whatever their
names, play no part and are kept by ``keep_good``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import released
from strata.storage import materialize

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
MARKS = [bytes([b]) for b in range(33, 127) if not chr(b).isalnum()]

ODD = bytes(b for b in range(33, 127) if not chr(b).isalnum())
RUN = re.compile(rb"([!-/:-@\[-`{-~])\1")

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_runs", "n_marks", "n_bytes", "n_odd")
_TYPE = pa.struct([(f, pa.int64()) for f in FEATURES])


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1}
    if not often:
        return 0
    covered = bytearray(len(words))
    for i in compress(range(len(windows)), map(often.__contains__, windows)):
        covered[i : i + 3] = b"\x01\x01\x01"
    return sum(covered)


def count_features(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words, without = text.split(), lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()] if words else []
    vocabulary = Counter(words)
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - without(SPACE),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(vocabulary),
        without(UPPER),
        without(LOWER),
        len(RUN.findall(text)),
        sum(vocabulary[m] for m in MARKS),
        len(text) - without(SPACE),
        without(ODD),
    )


def features(text: str) -> Column:
    """Column of structs of counts for a text column."""

    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in FEATURES) + ">")
    @released
    def run(texts: pa.Array) -> pa.Array:
        rows = [count_features(t) for t in texts.cast(pa.binary()).to_pylist()]
        columns = zip(*rows) if rows else [()] * len(FEATURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_TYPE))

    return run(text)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _band(value: Column, good: float, bad: float, ready: Column) -> Column:
    """Votes good up to ``good``, bad from ``bad`` on, abstains between and where not ready."""
    return F.when(ready & (value >= bad), -1).when(ready & (value <= good), 1).otherwise(0)


def rules(f: Column) -> dict[str, Column]:
    """Vote columns by rule name for a struct of features."""
    n, some, many = f["n_words"], f["n_words"] >= 10, f["n_words"] >= 100
    mean_chars = _share(f["word_chars"], n)
    return {
        "symbols": _band(_share(f["n_symbols"], n), 0.1, 0.3, some),
        "runs": _band(_share(f["n_runs"], n), 0.03, 0.15, some),
        "letters": _band(_share(f["n_odd"], f["n_bytes"]), 0.06, 0.09, some),
        "capitals": _band(_share(f["n_upper"], f["n_upper"] + f["n_lower"]), 0.15, 0.4, some),
        "repeats": _band(_share(f["n_repeat_words"], n), 0.1, 0.3, some),
        "lines": _band(_share(f["n_dup_lines"], f["n_lines"]), 0.1, 0.3, f["n_lines"] >= 3),
        "marks": _band(_share(f["n_marks"], n), 0.05, 0.2, some),
        "word_length": F.when(some & ((mean_chars < 2.5) | (mean_chars > 14)), -1).when(some & mean_chars.between(3, 11), 1).otherwise(0),
        "variety": _band(1 - _share(f["n_distinct"], n), 0.7, 0.9, many),
    }


RULES = ("symbols", "runs", "letters", "capitals", "repeats", "lines", "marks", "word_length", "variety")


VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class VoteModel:
    """Share of good texts and, by rule, the chance of each of VOTES on bad and on good texts."""

    prior: float
    bad: tuple[tuple[float, float, float], ...]
    good: tuple[tuple[float, float, float], ...]

    def weights(self) -> list[tuple[float, ...]]:
        """By rule, the log odds for good that each of VOTES adds."""
        return [tuple(math.log(g / b) for g, b in zip(good, bad)) for good, bad in zip(self.good, self.bad)]

    def odds(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def posterior(self, votes: Column) -> Column:
        """Probability that a text is good, for a struct of votes."""
        logit = F.lit(self.odds())
        for rule, (bad, none, good) in zip(RULES, self.weights()):
            logit = logit + F.when(votes[rule] < 0, bad).when(votes[rule] > 0, good).otherwise(none)
        return 1 / (1 + F.exp(-logit))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> VoteModel:
    """Vote chances and prior from (votes, documents) rows.

    The first posteriors follow the number of bad votes, which fixes what good
    means.  Each chance has a pseudo-count, the prior stays between 0.05 and
    0.98, and no rule may vote bad more often on good texts than on bad ones.
    """
    width = len(patterns[0][0]) if patterns else len(RULES)
    posterior = [(0.95, 0.2, 0.02)[min(2, votes.count(-1))] for votes, _ in patterns]
    total, model = sum(n for _, n in patterns), None
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(posterior, patterns))
        prior = min(0.98, max(0.05, (good + 7) / (total + 10)))
        chances = {}
        for side in (0, 1):
            counts = [[2.0, 1.0, 1.0] if side == 0 else [0.1, 1.0, 2.0] for _ in range(width)]
            for p, (votes, n) in zip(posterior, patterns):
                share = n * (p if side else 1 - p)
                for j, v in enumerate(votes):
                    counts[j][v + 1] += share
            chances[side] = [tuple(c / sum(row) for c in row) for row in counts]
        both = [(b, g) if b[0] >= g[0] else (m := tuple((x + y) / 2 for x, y in zip(b, g)), m) for b, g in zip(chances[0], chances[1])]
        model = VoteModel(prior, tuple(b for b, _ in both), tuple(g for _, g in both))
        weights, base = model.weights(), model.odds()
        new = []
        for votes, _ in patterns:
            logit = base + sum(w[v + 1] for v, w in zip(votes, weights))
            new.append(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))))
        moved, posterior = max((abs(a - b) for a, b in zip(new, posterior)), default=0.0), new
        if moved < 1e-9:
            break
    return model


def fit(votes: DataFrame) -> VoteModel:
    """Model from a table with a column ``votes`` (struct by rule)."""
    rows = votes.groupBy(*(F.col("votes")[r].alias(r) for r in RULES)).count().collect()
    return expectation_maximisation(sorted((tuple(r[:-1]), r[-1]) for r in rows))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _votes(f: Column) -> Column:
    return F.struct(*(v.cast("int").alias(r) for r, v in rules(f).items()))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and posterior of each document; texts are read once."""
    counted = materialize(docs.select("doc_id", features("text").alias("f")), "rule-features")
    counted = counted.withColumn("votes", _votes(F.col("f")))
    model, f = fit(counted), F.col("f")
    out = counted.select("doc_id", "f", model.posterior(F.col("votes")).alias("posterior"), base_failed(f).alias("base_failed"))
    return out.select(
        "doc_id",
        *(f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"),
        "posterior",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    model = fit(docs.select(features("text").alias("f")).select(_votes(F.col("f")).alias("votes")))
    f = features("text")
    return docs.where(~base_failed(f) & (model.posterior(_votes(f)) >= 0.5))
