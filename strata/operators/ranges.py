"""Joins of line ranges within files.

Ranges are spread over bins of BIN lines and meet in a bin of their file, so one giant
file is many keys.  A pair that shares several bins counts in one only: the first
bin that both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 256


def _bin(line: Column) -> Column:
    return F.floor(line / BIN)


def _bins(start: Column, end: Column) -> Column:
    return F.sequence(_bin(F.least(start, end)), _bin(F.greatest(start, end)))


def meeting(left: DataFrame, right: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str]) -> DataFrame:
    """All columns of pairs whose ranges meet; ``a`` and ``b`` name file, start and end on either side, all names distinct."""
    (fa, sa, ea), (fb, sb, eb) = a, b
    spread = lambda df, s, e, name: df.withColumn(name, F.explode(_bins(F.col(s), F.col(e))))
    first = F.greatest(_bin(F.least(sa, ea)), _bin(F.least(sb, eb)))
    pairs = spread(left, sa, ea, "_bin_a").join(spread(right, sb, eb, "_bin_b"), (F.col(fa) == F.col(fb)) & (F.col("_bin_a") == F.col("_bin_b")))
    meets = (F.col(sa) <= F.col(eb)) & (F.col(sb) <= F.col(ea))
    return pairs.where(meets & (F.col("_bin_a") == first)).drop("_bin_a", "_bin_b")


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Rows of ``inner`` whose range lies within one of ``outer`` in the same file; both have file, start_line and end_line."""
    wide = outer.select(F.col("file").alias("_file"), F.col("start_line").alias("_start"), F.col("end_line").alias("_end"), F.explode(_bins(F.col("start_line"), F.col("end_line"))).alias("_bin"))
    # A range that holds another has the bin where that begins.
    inside = (F.col("file") == F.col("_file")) & (_bin(F.col("start_line")) == F.col("_bin")) & (F.col("start_line") >= F.col("_start")) & (F.col("end_line") <= F.col("_end"))
    return inner.join(wide, inside, "left_semi")
