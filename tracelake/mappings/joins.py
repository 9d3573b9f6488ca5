"""Joins that the mappings share, over tables in which some cells are not known.

A decoded table may have a column ``_unknown``: a map from the names of a row's cells that couldn't be read to how (unread,
clipped, omitted). Such a cell is null, or a prefix, and that says nothing of what the app had stored. Three columns go along
with the rows of a mapping from there on:

* ``_unknown``: the row's own unknown cells;
* ``_joined_unknown``: unknown cells of rows that it was joined with, by join and cell;
* ``_undecided``: joins of which nobody can say whether they have a row: the key isn't known, or it has no row while some keys of
  the other table aren't known. ``_short``: joins with rows, of which there may be more, or whose values are not all known.

Tables without ``_unknown`` are known throughout; then none of these columns appear and no join does more work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, JOINED, UNDECIDED, SHORT = "_unknown", "_joined_unknown", "_undecided", "_short"
#: Goes along as well: the facts of a recovered row.
FACTS = "_facts"
_EMPTY = {UNKNOWN: "map<string,string>", JOINED: "map<string,string>", UNDECIDED: "array<string>", SHORT: "array<string>"}


def carried(rows: DataFrame) -> list[str]:
    """The bookkeeping columns that rows have: for the select of a mapping."""
    return [c for c in (*_EMPTY, FACTS) if c in rows.columns]


def _books(rows: DataFrame) -> DataFrame:
    """rows with all bookkeeping columns, none of them null."""
    empty = {c: (F.create_map() if c in (UNKNOWN, JOINED) else F.array()).cast(kind) for c, kind in _EMPTY.items()}
    return rows.withColumns({c: F.coalesce(F.col(c), e) if c in rows.columns else e for c, e in empty.items()})


def is_unknown(rows: DataFrame, *cells: str) -> Column:
    """Whether any of these cells of a row isn't known."""
    if UNKNOWN not in rows.columns:
        return F.lit(False)
    return F.coalesce(F.exists(F.map_keys(UNKNOWN), lambda k: k.isin(*cells)), F.lit(False))


def unknown_keys(rows: DataFrame, key: str) -> Column | None:
    """How many rows have an unknown key, as a scalar; None where all cells are known."""
    return rows.agg(F.count_if(is_unknown(rows, key))).scalar() if UNKNOWN in rows.columns else None


def _note(rows: DataFrame, name: str, undecided: Column, short: Column | None = None) -> DataFrame:
    add = lambda c, when: F.when(when, F.array_append(c, name)).otherwise(F.col(c))
    return rows.withColumns({UNDECIDED: add(UNDECIDED, undecided)} | ({SHORT: add(SHORT, short)} if short is not None else {}))


def lookup(rows: DataFrame, key: str, other: DataFrame, other_key: str, columns: dict[str, str], state: str, lost: Column | None = None, cell: str | None = None) -> DataFrame:
    """rows with columns (new name: name) of the one row of other with that key, and the state of the join.

    none: no key; undecided: an unknown key, or no such row while some keys of other (or lost rows) are unknown; unresolved: no
    such row; ambiguous: several rows, of which no values are taken; found. other becomes one row for each key first, so rows
    are never multiplied and a key with many rows is pre-aggregated. cell: the key's name as a cell, if it is another.
    """
    tracked = UNKNOWN in other.columns
    name = state.removesuffix("_state").strip("_")
    seen = {"_other_unknown": F.map_filter(UNKNOWN, lambda k, _: k.isin(*columns.values()))} if tracked else {}
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()], *[c.alias(n) for n, c in seen.items()])
    one = other.where(F.col(other_key).isNotNull() & ~is_unknown(other, other_key)).groupBy(F.col(other_key).alias("_key")).agg(F.count("*").alias("_n"), F.first(row).alias("_row"))
    known = ~is_unknown(rows, cell or key)
    joined = rows.withColumn("_asked", F.when(known, F.col(key))) if UNKNOWN in rows.columns else rows
    asked = "_asked" if UNKNOWN in rows.columns else key
    out = joined.join(one, F.col(asked) == one["_key"], "left")
    gaps = [c for c in (lost, unknown_keys(other, other_key)) if c is not None]
    open_ = F.lit(False)
    for gap in gaps:
        open_ = open_ | (gap > 0)
    how = F.when(~known, "undecided").when(F.col(asked).isNull(), "none").when(F.col("_n").isNull() & open_, "undecided").when(F.col("_n").isNull(), "unresolved").when(F.col("_n") > 1, "ambiguous").otherwise("found")
    taken = [F.when(F.col("_n") == 1, F.col(f"_row.{n}")).alias(n) for n in columns]
    out = out.select(*[F.col(c) for c in rows.columns], *taken, how.alias(state), *[F.when(F.col("_n") == 1, F.col(f"_row.{n}")).alias(n) for n in seen])
    if not (tracked or gaps or carried(rows)):
        return out
    out = _note(_books(out), name, F.col(state) == "undecided", open_ & F.col(state).isin("found", "ambiguous"))
    if tracked:
        theirs = F.transform_keys(F.coalesce("_other_unknown", F.create_map().cast(_EMPTY[JOINED])), lambda k, _: F.concat(F.lit(f"{name}."), k))
        out = out.withColumn(JOINED, F.map_concat(JOINED, theirs)).drop("_other_unknown")
    return out


def children(rows: DataFrame, key: str, child: DataFrame, child_key: str, name: str, values: dict[str, Column], cells: tuple[str, ...] = (), zeros: tuple[str, ...] = (), lost: Column | None = None) -> DataFrame:
    """rows with aggregates over their rows of child, which is aggregated by parent first.

    Of a parent without rows all values are null, and those named in zeros 0, unless that is undecided. cells: those of child
    that the values read; where one of them isn't known, the parent's values are short.
    """
    tracked = UNKNOWN in child.columns
    unread = {"_unread": F.bool_or(is_unknown(child, *cells))} if tracked else {}
    held = child.where(F.col(child_key).isNotNull() & ~is_unknown(child, child_key)).groupBy(F.col(child_key).alias("_parent")).agg(*[v.alias(n) for n, v in {**values, **unread}.items()], F.lit(True).alias("_held"))
    asked = F.when(~is_unknown(rows, key), F.col(key)) if UNKNOWN in rows.columns else F.col(key)
    out = rows.join(held, asked == held["_parent"], "left").drop("_parent")
    gaps = [c for c in (lost, unknown_keys(child, child_key)) if c is not None]
    open_ = F.lit(False)
    for gap in gaps:
        open_ = open_ | (gap > 0)
    undecided = is_unknown(rows, key) | (F.col("_held").isNull() & open_)
    out = out.withColumns({n: F.when(~undecided, F.coalesce(F.col(n), F.lit(0))).cast("bigint") for n in zeros})
    if not (tracked or gaps or carried(rows)):
        return out.drop("_held")
    short = F.col("_held").isNotNull() & (open_ | (F.coalesce("_unread", F.lit(False)) if tracked else F.lit(False)))
    out = out.withColumns({"_is_undecided": undecided, "_is_short": short})
    # An empty list of which something isn't known isn't known to be empty.
    out = out.withColumns({n: F.when(~(F.col("_is_short") & (F.col(n) == "")), F.col(n)) for n in values if out.schema[n].dataType.typeName() == "string"})
    return _note(_books(out), name, F.col("_is_undecided"), F.col("_is_short")).drop("_held", "_unread", "_is_undecided", "_is_short")


def marked(rows: DataFrame, key: str, other: DataFrame, other_key: str, name: str, to: str) -> DataFrame:
    """rows with a boolean: whether other has their key; null where that is undecided."""
    out = children(rows, key, other, other_key, name, {to: F.max(F.lit(True))})
    undecided = F.array_contains(UNDECIDED, name) if UNDECIDED in out.columns else F.lit(False)
    return out.withColumn(to, F.when(~undecided, F.coalesce(F.col(to), F.lit(False))))


def absent(rows: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """rows whose key other doesn't have, or of which that is undecided: these are noted as such."""
    known = other.where(F.col(other_key).isNotNull() & ~is_unknown(other, other_key)).select(F.col(other_key).alias("_other"))
    out = rows.join(known, F.col(key) == F.col("_other"), "left_anti")
    gap = unknown_keys(other, other_key)
    undecided = is_unknown(rows, key) | (F.lit(False) if gap is None else gap > 0)
    return out if gap is None and not carried(rows) else _note(_books(out), name, undecided)


def unknowns(rows: DataFrame) -> list[Column]:
    """What a record's payload says of what isn't known: unknown_columns, joined_unknown_columns, join_undecided, join_short; null where there is nothing to say."""
    names = {UNKNOWN: "unknown_columns", JOINED: "joined_unknown_columns", UNDECIDED: "join_undecided", SHORT: "join_short"}
    value = lambda c: F.map_from_entries(F.array_sort(F.map_entries(c))) if c in (UNKNOWN, JOINED) else F.array_sort(F.array_distinct(c))
    return [F.when(F.size(c) > 0, value(c)).alias(n) for c, n in names.items() if c in rows.columns]


def joined_text(order: list[str], text: Column, separator: str) -> Column:
    """Aggregate: the texts in the order of columns; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("_text")))))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), separator)


def listed(text: Column) -> Column:
    """Aggregate: the distinct texts in order, by commas."""
    return F.array_join(F.array_sort(F.collect_set(text)), ",")


def diagnostics(rows: DataFrame, states: list[str]) -> DataFrame:
    """join, state, n: how the joins of a mapping came out, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(s.removesuffix("_state")).alias("join"), F.col(s).alias("state")) for s in states]))
    return rows.select(each.alias("_j")).groupBy("_j.join", "_j.state").agg(F.count("*").alias("n"))
