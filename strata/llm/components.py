"""Connected components of an undirected graph in DataFrame joins.

Alternates large-star and small-star steps until the edges stop changing: then
every node points at the smallest node of its component.  Each round is written
to the shared folder.  A hub's rows are split by the joins' skew handling; its
minimum is pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    low = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("hub"), F.least("src", "low").alias("low"))
    return both.join(low, F.col("src") == F.col("hub")).where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("hub"), "low")
    moved = edges.join(low, F.col("src") == F.col("hub")).where("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(low.select("hub", "low")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, roots included; edges has integer columns src and dst."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    edges = materialize(edges.where("src != dst").select(high.alias("src"), low.alias("dst")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        edges = materialize(_small_star(_large_star(edges)), "edges")
    roots = edges.select("dst").distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(roots.select("dst", "dst"))
