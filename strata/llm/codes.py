"""Vector code compression: product quantisation on integer parts (operator 13).

A vector's components become whole numbers and are cut into ``PARTS`` equal parts,
each with a codebook of up to ``ENTRIES`` entries.  Vectors are laid out once as
columnar blocks: one row of the table of blocks holds about a thousand vectors,
dimension after dimension.  An RDD of these blocks is aggregated as a tree: within a
block distances to all entries accumulate dimension by dimension, ``np.add.at`` adds
the vectors to int64 tensors of sums and counts by part and entry, and the tensors
of tasks (40 KB for 64 dimensions, whatever the corpus) merge level by level.

Rows whose vector is null or empty, or holds a null, NaN or infinite component, are dropped.
The vectors' length is that of the kept row with the smallest id; kept rows of another
length are dropped too, as they have no distance to it, and a length that ``PARTS``
does not divide is an error.  Components beyond 2 ** 18 count as 2 ** 18, so that all
sums are exact in 64 bits.  Ties of distance go to the lower entry; among rows of equal
id the smaller vector comes first, and null ids come last, when codebooks are begun.
With fewer kept rows than entries the codebooks are shorter.  An entry that no part
is nearest to stays.  Repeated rows count and come out each; null labels are a label of their own;
no kept row gives an empty result; columns beside vec_id, embedding and label play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import small_batches
from strata.storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26  # of a scaled component
SPREAD = 64  # keys among which one label's rows are dealt
DEPTH = 3  # of the reduction tree

Books = np.ndarray  # (part, entry, dimension within the part), int64


def finite(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def scaled(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def blocks(kept: DataFrame, width: int) -> DataFrame:
    """vec_ids, labels and data of about a thousand vectors a row; data is int32, dimension after dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            data = np.ascontiguousarray(scaled(flat).reshape(batch.num_rows, width).T).astype("<i4")
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(k)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([data.tobytes()])], ["vec_ids", "labels", "data"])

    kinds = [kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_ids array<{kinds[0]}>, labels array<{kinds[1]}>, data binary")


def nearest(data: np.ndarray, books: Books) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each part of the vectors in ``data`` (dimension, row): its number, the nearest entries and their squared distances."""
    inside = books.shape[2]
    for part, entries in enumerate(books):
        distance = np.zeros((data.shape[1], len(entries)), np.int64)
        for d in range(inside):
            gap = data[part * inside + d].astype(np.int64)[:, None] - entries[None, :, d]
            distance += gap * gap
        found = distance.argmin(axis=1)
        yield part, found, distance[np.arange(len(found)), found]


def _columns(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(width, -1)


def refine(laid: DataFrame, books: Books) -> Books:
    """One round: the mean of the parts nearest to each entry, floored; an entry without any stays."""
    parts, _, inside = books.shape

    def add(tensors, row):
        sums, counts = tensors
        data = _columns(row.data, parts * inside)
        for part, found, _ in nearest(data, books):
            np.add.at(sums[part], found, data[part * inside : (part + 1) * inside].T)
            np.add.at(counts[part], found, 1)
        return tensors

    def merge(a, b):
        np.add(a[0], b[0], out=a[0])
        np.add(a[1], b[1], out=a[1])
        return a

    none = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    sums, counts = laid.select("data").rdd.treeAggregate(none, add, merge, DEPTH)
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def begin(kept: DataFrame) -> tuple[Books, int] | None:
    """The first codebooks and the vectors' length, from the ENTRIES smallest ids; None if nothing is kept."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    least = kept.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    if not least:
        return None
    width = len(least[0].embedding)
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    first = kept.where(F.size("embedding") == width).select("vec_id", "embedding").orderBy(*order).limit(ENTRIES).collect()
    vectors = scaled(np.array([r.embedding for r in first], np.float64).reshape(len(first), width)).astype(np.int64)
    return vectors.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy(), width


def books_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(laid: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code (an entry's number in two hex digits for each part) and error of each vector."""
    width = books.shape[0] * books.shape[2]
    types = [laid.schema[c].dataType.elementType for c in ("vec_ids", "labels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, data = (batch.column(c)[k] for c in range(3))
                found = np.empty((len(ids), books.shape[0]), np.uint8)
                error = np.zeros(len(ids), np.int64)
                for part, entry, distance in nearest(_columns(data.as_py(), width), books):
                    found[:, part] = entry
                    error += distance
                code = [row.tobytes().hex() for row in found]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return laid.mapInArrow(run, f"vec_id {types[0].simpleString()}, label {types[1].simpleString()}, code string, error bigint")


def by_label(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the errors of all rows of equal label; one label's rows meet it under SPREAD keys."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("dealt"))
    dealt = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SPREAD)).cast("int")
    joined = rows.withColumn("deal", dealt).join(sums, (F.col("deal") == F.col("dealt")) & F.col("label").eqNullSafe(F.col("of")))
    return joined.select(*rows.columns, "label_error")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """Codes of all kept vectors (vec_id, label, code, error), and the codebooks they refer to (None if nothing is kept)."""
    small_batches(vectors.sparkSession)
    kept = vectors.select("vec_id", "embedding", "label").where(finite(F.col("embedding")))
    begun = begin(kept)
    if begun is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0), None
    books, width = begun
    laid = materialize(blocks(kept.where(F.size("embedding") == width), width), "blocks")
    for _ in range(rounds):
        books = refine(laid, books)
    return materialize(coded(laid, books), "codes"), books


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector."""
    rows, books = compress(vectors)
    name = books_sha256(np.empty(0, np.int64) if books is None else books)
    return by_label(rows).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
