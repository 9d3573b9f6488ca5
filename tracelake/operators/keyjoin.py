"""Equality joins of columns whose values have kinds of their own, with an outcome that tells a miss from what nobody can know.

A side of a join is a column of cells (``functions.cells``), a column that says which cells are known, the column's class
(numeric, text, blob, or literal for a constant) and its collation. Values convert as classes ask: a text that meets a numeric
column is read as a number, a number that meets a text column meets the texts that read as it. What can't be converted exactly,
or isn't known, isn't a miss:

* none: the probe's key is null or NaN, which equals nothing;
* undecided: the probe's key can't be compared, or it has no hit while some key of the other side is unknown to its class: any
  unread key for all probes, number-like texts beyond exact conversion for numeric ones;
* match: hits, which are ``short`` where the same would have made a miss undecided;
* miss: no row has that key.

The other side is one row for each key before it is joined, and null keys take no part in the join, so no key gathers rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import cells

COLLATIONS = ("binary", "nocase", "rtrim")
CLASSES = ("numeric", "text", "blob", "literal")


@dataclass(frozen=True)
class Side:
    """A key column: its cells, the state of each (null if known), its class and collation."""

    cell: str
    state: str | None = None
    kind: str = "blob"
    collation: str = "binary"

    def __post_init__(self):
        if self.kind not in CLASSES or self.collation not in COLLATIONS:
            raise ValueError(f"{self.kind}, {self.collation}: no such class or collation")

    def known(self) -> Column:
        return F.lit(True) if self.state is None else F.col(self.state).isNull()


def converted(cell: Column, own: str, other: str) -> tuple[Column, Column]:
    """The cell as it is compared with a column of class other, and whether that conversion is exact."""
    if other == "numeric" and own != "numeric":
        n = cells.as_number(cell["t"])
        number = cells.cell(i=n["i"], r=n["r"])
        return F.when(n["state"] == "exact", number).otherwise(cell), ~F.coalesce(n["state"] == "undecided", F.lit(False))
    if other == "text" and own == "literal":
        text = cells.cell(t=cell["i"].cast("string"))
        return F.when(cell["i"].isNotNull(), text).otherwise(cell), cell["r"].isNull() | F.isnan(cell["r"])
    return cell, F.lit(True)


def _build(build: DataFrame, of: Side, numbers: bool, columns: dict[str, str]) -> tuple[DataFrame, Column]:
    """A row for each key (n, row), and the counts of keys that can't be told: struct(unknown, inexact, unkeyed)."""
    cell, known = F.col(of.cell), of.known()
    keys, inexact = [cells.equality_key(cell, of.collation)], F.lit(False)
    if numbers:  # texts of this column also meet the numbers that they read as
        n = cells.as_number(cell["t"])
        keys.append(F.when(n["state"] == "exact", cells.equality_key(cells.cell(i=n["i"], r=n["r"]))))
        inexact = F.coalesce(n["state"] == "undecided", F.lit(False))
    base = build.select(known.alias("_known"), inexact.alias("_inexact"), F.array(*keys).alias("_keys"), *[F.col(c).alias(f"_as_{n}") for n, c in columns.items()])
    counts = base.agg(
        F.struct(F.count_if(~F.col("_known")).alias("unknown"), F.count_if(F.col("_known") & F.col("_inexact")).alias("inexact"), F.count_if(~F.col("_known") | F.col("_keys")[0].isNull()).alias("unkeyed")).alias("c")
    )
    each = base.where("_known").select(F.explode("_keys").alias("_key"), *[f"_as_{n}" for n in columns]).where("_key IS NOT NULL")
    row = F.struct(*[F.col(f"_as_{n}").alias(n) for n in columns]) if columns else F.lit(0)
    return each.groupBy("_key").agg(F.count("*").alias("_n"), F.first(row).alias("_row")), counts.scalar()


def outcomes(probe: DataFrame, on: Side, build: DataFrame, to: Side, columns: dict[str, str] | None = None, lost: int = 0) -> DataFrame:
    """probe with ``outcome``, ``hits``, ``short`` and columns (new name: name) of the one row of build with that key.

    Of several hits no values are taken. lost: rows of build that a scan is known not to have given.
    """
    columns = columns or {}
    numbers = on.kind == "numeric" and to.kind != "numeric"
    one, counts = _build(build, to, numbers, columns)
    value, exact = converted(F.col(on.cell), on.kind, to.kind)
    probed = probe.withColumns({"_never": F.coalesce(on.known() & cells.nothing(F.col(on.cell)), F.lit(False)), "_fits": on.known() & exact})
    probed = probed.withColumn("_probe", F.when(F.col("_fits") & ~F.col("_never"), cells.equality_key(value, to.collation)))
    hit = probed.where("_probe IS NOT NULL").join(one, F.col("_probe") == F.col("_key"), "left").drop("_key")
    rest = probed.where("_probe IS NULL").withColumns({"_n": F.lit(None).cast("bigint"), "_row": F.lit(None).cast(hit.schema["_row"].dataType)})
    number = F.col(on.cell)["i"].isNotNull() | F.col(on.cell)["r"].isNotNull()
    open_ = (counts["unknown"] > 0) | F.lit(lost > 0) | (F.lit(numbers) & number & (counts["inexact"] > 0))
    outcome = F.when(F.col("_never"), "none").when(~F.col("_fits"), "undecided").when(F.col("_n") > 0, "match").when(open_, "undecided").otherwise("miss")
    taken = [F.when(F.col("_n") == 1, F.col("_row")[n]).alias(n) for n in columns]
    return hit.unionByName(rest).select(*probe.columns, *taken, outcome.alias("outcome"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("hits"), (F.coalesce(F.col("_n") > 0, F.lit(False)) & open_).alias("short"))


def report(found: DataFrame, on: Side, build: DataFrame, to: Side, table: str, column: str) -> DataFrame:
    """One row of diagnostics of a join: lookups by outcome, short hits, keys of build without a key, and whether the sides differ."""
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    _, counts = _build(build, to, False, {})
    return found.agg(F.count("*").alias("lookups"), *[of(o) for o in ("match", "miss", "undecided", "none")], F.count_if("short").alias("short")).select(
        F.lit(table).alias("table"), F.lit(column).alias("column"), "*", counts["unkeyed"].alias("unkeyed"), F.lit(on.collation != to.collation).alias("collation_differs"), F.lit(on.kind not in ("literal", to.kind)).alias("class_differs")
    )
