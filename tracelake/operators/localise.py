"""Finding which rows differ between two large sides by sums over ranges of ids, descended only where they differ.

A side's sums are a small table: for ranges of 16, 256, ... ids the number of rows and the sum of their hashes. They are made in one
pass over the side and can be kept beside it, a sixteenth of its rows and less for each level above. Two sides are compared from
the widest ranges down: a level's sums are looked at only below ranges that differed, and rows only in the last ranges. What is
read follows the number of faults, not the size of the sides. Sums are exact decimals of 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.sources.staging import staged

#: Bits of ids that a range of each level spans.
LEVELS = (4, 8, 12, 16, 20)
_STEP = 4


def _hash(columns: list[str]) -> Column:
    return F.xxhash64(*columns).cast("decimal(38,0)")


def sums(rows: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """bits, range, n, s: the sums of a side. Several rows may have one id; rows without an id are left out."""
    leaf = rows.where(F.col(id_column).isNotNull()).groupBy(F.shiftright(F.col(id_column).cast("bigint"), LEVELS[0]).alias("_r")).agg(F.count("*").alias("n"), F.sum(_hash(columns)).alias("s"))
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftright("_r", b - LEVELS[0]).alias("range")) for b in LEVELS]))
    return leaf.select(each.alias("_l"), "n", "s").groupBy("_l.bits", "_l.range").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _unequal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, state of those whose n or s differs."""
    both = left.select(key, F.col("n").alias("_n"), F.col("s").alias("_s")).join(right.select(key, "n", "s"), key, "full")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("n").isNull(), "extra").when(~(F.col("_n").eqNullSafe(F.col("n")) & F.col("_s").eqNullSafe(F.col("s"))), "differs")
    return both.select(key, state.alias("state")).where("state IS NOT NULL")


def differing(stored: DataFrame, stored_sums: DataFrame, expected: DataFrame, expected_sums: DataFrame, id_column: str, columns: list[str], trace: list | None = None) -> DataFrame:
    """id, state: missing (expected alone has rows of that id), extra (stored alone), or differs.

    trace: gets (bits, sums looked at) for each level, and (0, rows looked at) for the rows, of both sides.
    """
    wrong = None
    for bits in reversed(LEVELS):
        sides = [side.where(F.col("bits") == bits).select("range", "n", "s") for side in (stored_sums, expected_sums)]
        if wrong is not None:
            below = wrong.select(F.col("range").alias("_above"))
            sides = [s.join(below, F.shiftright("range", _STEP) == F.col("_above"), "left_semi") for s in sides]
        if trace is not None:
            trace.append((bits, sum(s.count() for s in sides)))
        wrong = staged(_unequal(*sides, "range"), f"localise-{bits}")
    last = wrong.select(F.col("range").alias("_above"))
    sides = [s.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), _hash(columns).alias("_h")).join(last, F.shiftright("id", LEVELS[0]) == F.col("_above"), "left_semi") for s in (stored, expected)]
    if trace is not None:
        trace.append((0, sum(s.count() for s in sides)))
    return _unequal(*[s.groupBy("id").agg(F.count("*").alias("n"), F.sum("_h").alias("s")) for s in sides], "id")
