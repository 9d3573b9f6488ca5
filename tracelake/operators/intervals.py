"""Byte runs: union, gaps and translation, by windows over sorted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_runs(runs: DataFrame, key: str) -> DataFrame:
    """key, start, stop of the union of runs (key, start, stop): gaps and islands; runs that touch become one."""
    order = Window.partitionBy(key).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.where("stop > start").withColumn("_before", before)
    marked = marked.withColumn("_island", F.sum(F.when(F.col("_before") >= F.col("start"), 0).otherwise(1)).over(order))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def complement(merged: DataFrame, key: str) -> DataFrame:
    """The gaps between the runs of merge_runs."""
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return merged.select(key, F.col("stop").alias("start"), nxt.alias("stop")).where("stop IS NOT NULL")


#: Each level of cells is so many times as wide as the one below.
FACTOR, LEVELS = 64, 10


def _level(size: Column, cell: int) -> Column:
    """The first level whose cells are as wide as a range."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(size <= min(cell * FACTOR**k, (1 << 63) - 1), k).otherwise(out)
    return out


def _whole(at: Column) -> Column:
    """The cell of a byte, exact for all offsets from 0."""
    return F.call_function("div", at, F.col("_width"))


def _cells(side: DataFrame, lo: str, hi: str, levels: Column, cell: int) -> DataFrame:
    """side on each of these levels, with the cells that it touches there: two at most from its own level up."""
    widths = F.array(*[F.lit(min(cell * FACTOR**k, 1 << 62)).cast("bigint") for k in range(LEVELS)])
    laid = side.withColumn("_at", F.explode(levels)).withColumn("_width", F.element_at(widths, F.col("_at") + 1))
    return laid.withColumn("_cell", F.explode(F.sequence(_whole(F.col(lo)), _whole(F.col(hi) - 1))))


def _beside(side: DataFrame, other: DataFrame) -> DataFrame:
    """side, with the levels that ranges of other are of: one row, whatever the size of other."""
    return side.crossJoin(F.broadcast(other.agg(F.collect_set("_own").alias("_used"))))


def translate(ranges: DataFrame, extents: DataFrame, key: str, cell: int) -> DataFrame:
    """ranges (key, id, start, stop) through extents (key, at, size, target): id, target_start, length of each piece.

    A range join by cells in levels: every side lies in two cells at most of the level of its own size, and meets smaller
    ones of the other side there, which are laid on those levels above their own that the other side has ranges of. So a
    range of a terabyte is a few rows. The joins are merges by hint: Spark estimates sizes from compressed files, without
    the rows that cells make, and would send all of these through the driver as a broadcast.
    """
    r = ranges.where("stop > start").withColumn("_own", _level(F.col("stop") - F.col("start"), cell))
    e = extents.where("size > 0").withColumns({"_end": F.col("at") + F.col("size"), "_own": _level(F.col("size"), cell)})
    own, used = F.col("_own"), F.col("_used")
    on = lambda side, lo, hi, levels: _cells(side, lo, hi, levels, cell).drop("_own", "_used")
    met = on(r, "start", "stop", F.array(own)).join(on(_beside(e, r), "at", "_end", F.filter(used, lambda k: k >= own)).drop("_width").hint("merge"), [key, "_at", "_cell"]).unionByName(
        on(_beside(r, e), "start", "stop", F.filter(used, lambda k: k > own)).join(on(e, "at", "_end", F.array(own)).drop("_width").hint("merge"), [key, "_at", "_cell"])
    )
    lo, hi = F.greatest("start", "at"), F.least("stop", "_end")
    first_cell = _whole(lo) == F.col("_cell")  # a pair that shares two cells counts in the first
    return met.where((lo < hi) & first_cell).select("id", (F.col("target") + lo - F.col("at")).alias("target_start"), (hi - lo).alias("length"))
