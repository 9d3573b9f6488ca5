"""Typed cells: columns that hold null, integers, reals, texts and bytes side by side, with one order and one equality.

A cell is a struct of i (bigint), r (double), t (string) and b (binary), of which one is set at most.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(i: Column | None = None, r: Column | None = None, t: Column | None = None, b: Column | None = None) -> Column:
    part = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(part(i, "bigint").alias("i"), part(r, "double").alias("r"), part(t, "string").alias("t"), part(b, "binary").alias("b"))


def order_key(c: Column) -> Column:
    """Sorts nulls (and NaN) before numbers before texts before bytes; integers and reals compare exactly.

    An integer sorts by its nearest double, and by what that rounding took away where doubles are equal.
    """
    near = F.coalesce(c["i"].cast("double"), F.when(~F.isnan(c["r"]), c["r"]))
    rest = F.coalesce(c["i"].cast("decimal(20,0)") - c["i"].cast("double").cast("decimal(20,0)"), F.lit(0)).cast("decimal(20,0)")
    kind = F.when(near.isNotNull(), 1).when(c["t"].isNotNull(), 2).when(c["b"].isNotNull(), 3).otherwise(0)
    return F.struct(kind.alias("kind"), near.alias("near"), rest.alias("rest"), c["t"].cast("binary").alias("t"), c["b"].alias("b"))


def nothing(c: Column) -> Column:
    """Null and NaN, which equal nothing."""
    return c["i"].isNull() & c["t"].isNull() & c["b"].isNull() & (c["r"].isNull() | F.isnan(c["r"]))


def equality_key(c: Column, collation: str = "binary") -> Column:
    """Equal cells have equal keys: a real that is an integer equals it. Null and NaN equal nothing and have no key.

    Texts compare by collation: nocase folds ASCII letters and looks at what follows a NUL by its length alone; rtrim leaves
    spaces at the end out.
    """
    whole = (c["r"] >= F.lit(-float(1 << 63))) & (c["r"] < F.lit(float(1 << 63))) & (F.floor(c["r"]) == c["r"])
    number = F.coalesce(c["i"].cast("string"), F.when(whole, c["r"].cast("bigint").cast("string")), F.when(~F.isnan(c["r"]), c["r"].cast("string")))
    text = c["t"]
    if collation == "nocase":
        folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        text = F.concat(F.octet_length(text).cast("string"), F.lit(":"), F.substring_index(folded, "\0", 1), F.when(F.contains(text, F.lit("\0")), "\0").otherwise(""))
    elif collation == "rtrim":
        text = F.rtrim(text)
    return F.coalesce(F.sha2(F.concat(F.lit("n"), number), 256), F.sha2(F.concat(F.lit("t"), text), 256), F.sha2(F.concat(F.lit("b"), F.hex(c["b"])), 256))


def as_number(t: Column) -> Column:
    """Struct state, i, r of a text that meets a number: exact, text (no number) or undecided (more digits than a double holds)."""
    s = F.trim(t)
    integer = s.rlike("^[+-]?[0-9]+$")
    number = s.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    digits = F.length(F.regexp_replace(F.regexp_replace(s, "[eE].*$", ""), "[^0-9]", ""))
    power = F.coalesce(F.regexp_extract(s, "[eE][+]?(-?[0-9]{1,9})$", 1).try_cast("int"), F.when(s.rlike("[eE]"), 1 << 20).otherwise(0))
    exact = (integer & (digits <= 18)) | (number & (digits <= 15) & (F.abs(power) <= 22))
    state = F.when(exact, "exact").when(number, "undecided").when(t.isNotNull(), "text")
    return F.struct(state.alias("state"), F.when(exact & integer, s.try_cast("bigint")).alias("i"), F.when(exact & ~integer, s.try_cast("double")).alias("r"))
