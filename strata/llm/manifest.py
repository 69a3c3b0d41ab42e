"""Merkle manifest of a dataset, with a proof for every row (operator 11).

A leaf is the digest of a row's columns.  The leaves of a group, in order, are
folded ``WIDTH`` at a time into nodes until one is left, the group's subroot; the
subroots, in order of their groups, are folded likewise into the root.

A leaf's proof is a coordinate lookup.  From its index and its group's size follow
the coordinates (level, index) of the nodes above it, whose inputs are its siblings.
The leaves of one run need the same coordinates, so a run explodes them once, joins
the materialised node table, orders what it found and concatenates it; each leaf of
the run then folds its own digest into that path.  A node far up is asked for by all
runs below it: from level ``NEAR`` on node and request carry the stretch of 4,096 leaves
for which the node is asked, so no key of the join has more than 256 requests, whatever
share of the rows one group holds.

Rows are ranked within their groups by a range partitioning of digests (texts do not
travel) and counts for each pair of group and partition: no window sees a whole group.

Null columns count as ``-``; rows of a null group are a group of their own, the first.
Null ids come first in their group.  Rows of equal id are ordered by leaf, so equal
rows have neighbouring places and the same result set whatever the input's order; a
row repeated is a leaf repeated.  Empty texts differ from null ones.  Texts of any
length are hashed whole, in the scan.  A group of one row is its own subroot, with no
siblings; an empty table gives an empty result.  Columns that are not named in the
manifest, whatever they are called, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.storage import materialize

WIDTH = 16
BITS = 4  # of an index, for each level
DIGITS = 64  # of a digest
NEAR = 4
ROWS = 200_000  # leaves a range partition
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as a digest takes it: ``-`` if null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, grp, leaf and now: a row's digest as it was and, where ``altered`` gives another text, as it has become.

    ``grp`` is the source behind a mark, empty for null: it sorts as the sources do, null first, and joins as plain equality.
    """
    columns = [F.col(c) for c in COLUMNS]
    now = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), digest(*columns[:-1], altered))
    grp = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select(F.col("doc_id"), grp.alias("grp"), digest(*columns).alias("leaf"), now.alias("now"))


def tampered(text: Column, doc_id: Column, every: int = 5) -> Column:
    """The text with A-Z lowered where ``every`` divides the id's checksum, else null."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.translate(text, _UPPER, _LOWER))


def _right(value: Column | str, bits: Column) -> Column:
    return F.call_function("shiftright", F.col(value) if isinstance(value, str) else value, bits)


def _left(value: Column | str, bits: Column) -> Column:
    return F.call_function("shiftleft", F.col(value) if isinstance(value, str) else value, bits)


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: the digits of n - 1 to base 16, none for a lone leaf."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place`` in their group ``grp``, from 0 in ``order``, and ``n``, the group's size."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    sorted_rows = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    # An id's upper bits are its partition's number, the lower ones count within it.
    placed = materialize(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    # A row for each group, and one more for each partition at most.
    sizes = placed.groupBy("grp", "part").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    whole, earlier = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("held").over(earlier), F.lit(0))
    offset = sizes.select("grp", "part", F.sum("held").over(whole).alias("n"), (before - F.col("first")).alias("shift"))
    return placed.join(offset, ["grp", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("place"), "n")


def _stretch(place: Column) -> Column:
    return F.shiftright(place, BITS * (NEAR - 1))


@dataclass
class Tree:
    """Trees over the leaves of each group.

    leaves: the rows with grp, leaf, place and n.  nodes: grp, level (from 1), place, n (leaves of
    the group), inputs (the digests below, concatenated) and hash.  tops: grp and subroot.
    """

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame


def tree(rows: DataFrame, *order: str) -> Tree:
    """The trees of ``rows`` (grp, leaf and whatever else), their leaves in ``order``; a lone leaf has no node."""
    rows = materialize(ranked(rows, *order), "leaves")
    largest = rows.agg(F.max("n")).first()[0] or 0
    below, levels = rows.select("grp", "place", "n", F.col("leaf").alias("hash")), []
    for level in range(1, (len(f"{largest - 1:x}") if largest > 1 else 0) + 1):
        runs = below.where(height(F.col("n")) >= level).groupBy("grp", F.shiftright("place", BITS).alias("place"))
        inputs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]), "")
        folded = runs.agg(F.first("n").alias("n"), inputs.alias("inputs")).select("grp", F.lit(level).alias("level"), "place", "n", "inputs", F.sha2("inputs", 256).alias("hash"))
        levels.append(materialize(folded, "nodes"))
        below = levels[-1]
    none = rows.sparkSession.createDataFrame([], "grp string, level int, place bigint, n bigint, inputs string, hash string")
    nodes = reduce(DataFrame.unionByName, levels, none)
    single = rows.where("n = 1").select("grp", F.col("leaf").alias("subroot"))
    tops = nodes.where(F.col("level") == height(F.col("n"))).select("grp", F.col("hash").alias("subroot"))
    return Tree(rows, nodes, materialize(tops.unionByName(single), "subroots"))


def paths(trees: Tree) -> DataFrame:
    """grp, run, and path: the (level, inputs) of all nodes above the leaves of that run, from below; empty over a lone leaf."""
    high, first = F.col("level") >= NEAR, _left("place", F.col("level") * BITS)
    runs = trees.leaves.groupBy("grp", F.shiftright("place", BITS).alias("run")).agg(F.first("n").alias("n"))
    top = height(F.col("n"))
    asked = runs.select("grp", "run", F.explode(F.sequence(F.lit(1), F.greatest(top, F.lit(1)))).alias("level"))
    asked = asked.withColumn("place", _right("run", (F.col("level") - 1) * BITS))
    asked = asked.withColumn("stretch", F.when(high, _stretch(F.shiftleft("run", BITS))).otherwise(-1))
    last = F.least(_left(F.col("place") + 1, F.col("level") * BITS), F.col("n")) - 1
    stretches = F.when(high, F.sequence(_stretch(first), _stretch(last))).otherwise(F.array(F.lit(-1).cast("bigint")))
    given = trees.nodes.select("grp", "level", "place", F.explode(stretches).alias("stretch"), "inputs")
    found = asked.join(given, ["grp", "level", "place", "stretch"], "left")
    step = F.when(F.col("inputs").isNotNull(), F.struct("level", "inputs"))
    return found.groupBy("grp", "run").agg(F.array_sort(F.collect_list(step)).alias("path"))


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, now, subroot, root and proof of each row of ``leaves``.

    A proof is a list of steps from the leaf to the root: ``at``, the digest's own place
    among the inputs of the node above, and those inputs.
    """
    own = tree(docs, "doc_id", "leaf")
    whole = tree(own.tops.select(F.lit("").alias("grp"), F.col("subroot").alias("leaf"), F.col("grp").alias("member")), "member")
    above = paths(whole).select("run", F.col("path").alias("upper"))
    root = next((r.subroot for r in whole.tops.collect()), None)  # one row, or none
    groups = whole.leaves.withColumn("run", F.shiftright("place", BITS)).join(above, "run")
    groups = groups.select(F.col("member").alias("grp"), F.col("leaf").alias("subroot"), F.lit(root).cast("string").alias("root"), F.col("place").alias("upper_place"), "upper")
    groups = groups.join(own.leaves.where("place = 0").select("grp", "n"), "grp")
    # A row for each stretch of a group, so that the runs of a large group meet it under many keys.
    groups = groups.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), _stretch(F.col("n") - 1)))).drop("n")
    runs = paths(own).withColumn("stretch", _stretch(F.shiftleft("run", BITS))).join(groups, ["grp", "stretch"]).drop("stretch")
    rows = own.leaves.withColumn("run", F.shiftright("place", BITS)).join(runs, ["grp", "run"])

    def steps(path: str, place: str) -> Column:
        at = lambda x: _right(place, (x["level"] - 1) * BITS).bitwiseAND(WIDTH - 1)
        return F.transform(path, lambda x: F.struct(at(x).cast("int").alias("at"), x["inputs"].alias("inputs")))

    return rows.select("doc_id", "leaf", "now", "subroot", "root", F.concat(steps("path", "place"), steps("upper", "upper_place")).alias("proof"))


def siblings(proof: Column) -> Column:
    """The digests of all siblings along a proof, concatenated."""
    return F.array_join(F.transform(proof, lambda x: F.overlay(x["inputs"], F.lit(""), x["at"] * DIGITS + 1, DIGITS)), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda d, x: F.sha2(F.overlay(x["inputs"], d, x["at"] * DIGITS + 1, DIGITS), 256))


def verify(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document.

    ``altered`` gives the text with which a document is checked, null where it is as it was.
    """
    found = materialize(leaves(docs, altered), "digests")
    given = proofs(found).withColumn("folded_root", fold(F.coalesce("now", "leaf"), F.col("proof")))
    return given.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
