"""Quality classifier on random Fourier features (operator 1).

Every text gives a vector of statistics.  Standardised over all documents, they
pass through random Fourier features that approximate a Gaussian kernel.  Each
partition sums its share of the normal equations, groups of partitions add
theirs up, and the driver solves a ridge system of fixed size.  Isotonic
regression on a fixed grid of raw scores calibrates the result.

A held-out document (crc32 of its doc_id as text, modulo 4, is 2) never lends
its label.  Null text counts as empty; a null doc_id is not held out and has no
label.  Labels other than 0 and 1 are ignored and repeated ones averaged.
Without any labels every score is one half.  Equal texts score alike, so ties
stay ties; repeated rows get a result row each; an empty table gives an empty
result.  Further columns of either table, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.quality_rules import FEATURES, count_features
from strata.storage import materialize

FOURIER = 256
RIDGE = 1.0
GRID = 1024
LOW, HIGH = -0.5, 1.5
DIGITS = b"0123456789"
ENDS = b".!?"
STATISTICS = (
    "log_words", "log_chars", "word_chars", "symbols", "odd", "upper", "digits", "runs", "marks",
    "distinct", "repeats", "dup_lines", "log_lines", "words_per_line", "spaces", "wide", "ends", "commas",
)


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    c = dict(zip(FEATURES, count_features(text)))
    words, chars, size = max(1, c["n_words"]), max(1, c["n_bytes"]), max(1, len(text))
    count = lambda marks: len(text) - len(text.translate(None, marks))
    return [
        np.log1p(c["n_words"]),
        np.log1p(len(text)),
        c["word_chars"] / words,
        c["n_symbols"] / words,
        c["n_odd"] / chars,
        c["n_upper"] / max(1, c["n_upper"] + c["n_lower"]),
        count(DIGITS) / chars,
        c["n_runs"] / words,
        c["n_marks"] / words,
        c["n_distinct"] / words,
        c["n_repeat_words"] / words,
        c["n_dup_lines"] / max(1, c["n_lines"]),
        np.log1p(c["n_lines"]),
        np.log1p(c["n_words"] / max(1, c["n_lines"])),
        1 - c["n_bytes"] / size,
        (c["n_bytes"] - c["word_chars"]) / chars,
        count(ENDS) / words,
        count(b",") / words,
    ]


def statistics_column(text: str) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))

    return run(text)


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: each block's mean x and value."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    found = np.array(blocks).reshape(-1, 3)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / FOURIER)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(stats) @ self.weights, LOW, HIGH)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated score; a thousandth of the raw one keeps an order within flat stretches."""
        if not len(self.knots):
            return np.full(len(raw), 0.5)
        fit = np.interp(raw, self.knots, self.values)
        return np.clip(0.999 * fit + 0.001 * (raw - LOW) / (HIGH - LOW), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _apply(stats: str, run) -> Column:
    @F.arrow_udf("double")
    def apply(rows: pa.Array) -> pa.Array:
        return pa.array(run(_matrix(rows)) if len(rows) else [], pa.float64())

    return apply(stats)


def normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of outer products and of products with the label over (stats, label) rows."""
    size = FOURIER + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = model.fourier(_matrix(batch.column(0))), batch.column(1).to_numpy()
                total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in table.column("total"))
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    # Each partition sends one matrix of fixed size; groups of about the root of their number are added first.
    sums = rows.select("stats", "label").mapInArrow(part, "part bigint, total binary")
    groups = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    found = sums.groupBy(F.pmod("part", F.lit(groups)).alias("set")).applyInArrow(add, "total binary").collect()
    total = sum((np.frombuffer(r.total) for r in found), np.zeros(size * (size + 1))).reshape(size, size + 1)
    return total[:, :-1], total[:, -1]


def fit(stats: DataFrame, labels: DataFrame, seed: int = 7) -> QualityModel:
    """Model from (doc_id, stats) of all documents and (doc_id, quality) labels outside the held-out rows."""
    width = len(STATISTICS)
    moments = stats.select(*(f(F.col("stats")[i]) for i in range(width) for f in (F.avg, F.stddev_pop))).first()
    moments = [0.0 if m is None or m != m else m for m in moments]
    mean, scale = np.array(moments[0::2]), np.array(moments[1::2])
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / np.sqrt(width), (width, FOURIER))
    model = QualityModel(mean, np.where(scale > 1e-12, scale, 1.0), directions, rng.uniform(0, 2 * np.pi, FOURIER), np.zeros(FOURIER + 1), np.empty(0), np.empty(0))

    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.avg("quality").alias("label"))
    train = materialize(stats.join(known, F.col("doc_id") == F.col("labelled")).select("stats", "label"), "labelled-statistics")
    gram, moment = normal_equations(train, model)
    n = gram[-1, -1]
    if n == 0:
        return model
    weights = np.linalg.solve(gram + RIDGE * np.diag([*[1.0] * FOURIER, 1e-9]), moment)
    model = QualityModel(**{**vars(model), "weights": weights})
    cell = F.floor((F.col("raw") - LOW) / (HIGH - LOW) * GRID).alias("cell")
    grid = train.select(_apply("stats", model.raw).alias("raw"), "label").groupBy(cell).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n"))
    rows = sorted(grid.select("x", "y", "n").collect())  # at most GRID + 1 rows
    knots, values = isotonic(*np.array(rows, float).T)
    return QualityModel(**{**vars(model), "knots": knots, "values": values})


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = materialize(docs.select("doc_id", statistics_column("text").alias("stats")), "statistics")
    model = fit(stats, labels)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _apply("stats", lambda s: model.score(model.raw(s))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
