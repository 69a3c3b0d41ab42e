"""SimHash near-duplicates by tiled exact comparison (operator 5).

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's
shingles.  Distinct fingerprints are laid in tiles by their population counts:
the counts of set bits in each of ``WORDS`` equal parts of the 64.  Two
fingerprints within the radius cannot differ by more than it in the sum of
these counts' differences, so only tile pairs within that distance are compared,
in numpy by exclusive-or and bit counts.  Tiles are cut to about ``TILE``
fingerprints by a hash.  A pair of tiles gives a spanning forest of its links
rather than all of them, which keeps components and loses no connection.

Null and empty texts have fingerprint zero and are linked like any other.
Copies collapse to one fingerprint before any comparison.  Null doc_ids never
name a component unless all its rows lack one.  A bit set in exactly half of the
hashes is zero.  Repeated rows get a result row each; an empty table gives an
empty result; columns besides doc_id and text play no part and are kept by
``keep_one_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import release_memory, released
from strata.llm.components import components
from strata.storage import materialize

WORDS = 4
TILE = 4096
SLICE = 512


def fingerprint(text: bytes | None, size: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(joined, 42)
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops]
    hashes = np.fromiter((h(joined[a : b - 1], 42) for a, b in zip(starts, stops[size - 1 :])), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text, size: int = 3):
    """Column of fingerprints as signed 64-bit integers."""

    @F.arrow_udf("bigint")
    @released
    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, size) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return run(text)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links between two tiles, or within one if ``right`` is None."""
    values = left if right is None else np.concatenate([left, right])
    other, shift = (left, 0) if right is None else (right, len(left))
    label = np.arange(len(values))
    for lo in range(0, len(left), SLICE):
        near = np.bitwise_count(left[lo : lo + SLICE, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + lo, j + shift
        keep = i < j
        i, j = i[keep], j[keep]
        while len(i):
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[label[moved]], values[moved]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2)):
                a, b = (np.asarray(x.values).view(np.uint64) for x in (left, right))
                u, v = forest(a, None if same.as_py() else b, radius)
                src.append(u.view(np.int64))
                dst.append(v.view(np.int64))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], ["src", "dst"])
            release_memory()

    return run


def _one_of_two(a: Column, b: Column) -> Column:
    """Keeps (a, b) or (b, a) of each pair, and (a, a), so that each b gets about half of all a."""
    odd = (a + b) % 2 == 1
    return (a == b) | ((a < b) & odd) | ((a > b) & ~odd)


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst): spanning links of the distinct fingerprints in column ``fp``."""
    bits = 64 // WORDS
    side = bits + 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", bits * k).bitwiseAND((1 << bits) - 1)) for k in range(WORDS)]
    placed = prints.select("fp", *(c.alias(f"c{k}") for k, c in enumerate(counts)))
    place = lambda cs: sum((c * side**k for k, c in enumerate(cs)), F.lit(0))
    own = [F.col(f"c{k}") for k in range(WORDS)]
    placed = placed.withColumn("place", place(own))
    # At most (64 / WORDS + 1) ^ WORDS rows, however many fingerprints there are.
    parts = placed.groupBy("place").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    cut = placed.join(F.broadcast(parts), "place").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    tiles = cut.groupBy("place", "part", *(f"c{k}" for k in range(WORDS))).agg(F.collect_list("fp").alias("fps"))
    tiles = materialize(tiles, "tiles")

    # Tiles meet by their names; the fingerprints of the pairs come by a tile's whole name, so a place of many tiles is many keys.
    names = tiles.select(*own, F.col("place").alias("place_a"), F.col("part").alias("part_a"))
    steps = [s for s in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, s)) <= radius and s >= (0,) * WORDS]
    near = names.withColumn("step", F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))))
    moved = [own[k] + F.col("step")[k] for k in range(WORDS)]
    inside = reduce(Column.__and__, (m.between(0, bits) for m in moved))
    near = near.where(inside).select("place_a", "part_a", place(moved).alias("place_b"))
    near = near.join(tiles.select(F.col("place").alias("place_b"), F.col("part").alias("part_b")), "place_b")
    near = near.where((F.col("place_a") != F.col("place_b")) | _one_of_two(F.col("part_a"), F.col("part_b")))
    given = lambda side: tiles.select(F.col("place").alias(f"place_{side}"), F.col("part").alias(f"part_{side}"), F.col("fps").alias(side))
    pairs = near.join(given("a"), ["place_a", "part_a"]).join(given("b"), ["place_b", "part_b"])
    pairs = pairs.select("a", "b", ((F.col("place_a") == F.col("place_b")) & (F.col("part_a") == F.col("part_b"))).alias("same"))
    return pairs.mapInArrow(_compare(radius), "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fp (signed fingerprint) and component_id of every document."""
    marked = materialize(docs.select(F.col("doc_id"), fingerprint_column("text", size).alias("fp")), "fingerprints")
    return marked.join(_component_of(marked, radius).select("fp", "component_id"), "fp")


def _component_of(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of (doc_id, fp); components may share a component_id, never a root."""
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "first-of-fingerprint")
    roots = components(links(first.select("fp"), radius))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def hex_column(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_each(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Among rows of that same doc_id the first one stays, and a row without doc_id
    only where the whole component has none.
    """
    names = docs.columns
    row, fp, root = "_strata_row", "_strata_fp", "_strata_root"
    stored = materialize(docs.withColumn(fp, fingerprint_column("text", size)).withColumn(row, F.monotonically_increasing_id()), "deduplicated")
    marked = stored.select("doc_id", fp, row)
    found = _component_of(marked.select("doc_id", F.col(fp).alias("fp")), radius)
    placed = marked.join(found.select(F.col("fp").alias(fp), F.col("root").alias(root)), fp)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))
    chosen = placed.groupBy(root).agg(first.alias("first")).select(F.col("first")[row].alias(row))
    return stored.join(chosen, row, "left_semi").select(*names)
