"""Texts, dates and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import COCOA, WEBKIT, floor_div, plausible

#: Milliseconds of 1973-01-01, and confidence by how a carved file ends.
MS_1973 = 94_694_400_000
CARVED = {"validated": 70, "footer": 50, "bounded": 25}


def summary(text: Column, limit: int = 80) -> Column:
    """White space and control characters become one space each run; cut at limit characters, the last three of them dots."""
    s = F.trim(F.regexp_replace(text, r"[\p{Z}\p{Cc}]+", " "))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 3), F.lit("...")))


def duration_seconds(d: Column) -> Column:
    """Struct state, seconds of a calendar duration ([+-]P, weeks, days, hours, minutes, seconds, each once at most).

    too-long: a number of more than nine digits; unparsed: another form; out-of-range: beyond 32 bits.
    """
    form = r"^([+-]?)P(?:([0-9]{1,9})W)?(?:([0-9]{1,9})D)?T?(?:([0-9]{1,9})H)?(?:([0-9]{1,9})M)?(?:([0-9]{1,9})S)?$"
    total = F.lit(0).cast("bigint")
    for group, size in zip(range(2, 7), (604_800, 86_400, 3_600, 60, 1)):
        total = total + F.coalesce(F.regexp_extract(d, form, group).try_cast("bigint"), F.lit(0)) * size
    total = F.when(d.startswith("-"), -total).otherwise(total)
    state = F.when(d.rlike("[0-9]{10}"), "too-long").when(~d.rlike(form) | ~d.rlike("[0-9]"), "unparsed").when(F.abs(total) > (1 << 31) - 1, "out-of-range").when(d.isNotNull(), "ok")
    return F.struct(state.alias("state"), F.when(state == "ok", total).alias("seconds"))


def real_date(d: Column) -> Column:
    """Whether YYYY-MM-DD, or --MM-DD of any year, is a day of the calendar."""
    whole = F.when(d.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), d).when(d.rlike("^--[0-9]{2}-[0-9]{2}$"), F.concat(F.lit("2000"), F.substring(d, 2, 6)))
    return whole.try_cast("date").isNotNull()


def cocoa_us(v: Column) -> Column:
    """Microseconds of seconds (double) since 2001; 0, -1, NaN, infinities and beyond 1e11 are no times."""
    ok = ~F.isnan(v) & (F.abs(v) <= 1e11) & ~v.isin(0.0, -1.0)
    return F.when(ok, plausible((F.floor(F.round(F.when(ok, v) * 1e6, 3)) + COCOA * 1_000_000).cast("bigint")))


def filetime_us(v: Column) -> Column:
    """Microseconds of 100 ns steps since 1601."""
    return F.when(~v.isin(0, -1), plausible(floor_div(v, 10) + WEBKIT * 1_000_000))


def guarded_ms_us(v: Column) -> Column:
    """Microseconds of milliseconds; before 1973 they are likely seconds, and no time."""
    return F.when((v >= MS_1973) & (v < 1 << 50), plausible(v * 1000))


def unwrap_label(label: Column) -> Column:
    return F.regexp_replace(label, r"^_\$!<(.*)>!\$_$", "$1")


def target_guid(v: Column) -> Column:
    """The message that a reaction names, without its part."""
    s = F.regexp_replace(v, "^(p:[0-9]+/|bp:)", "")
    return F.when(s.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), s)


def carve_confidence(how: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in CARVED.items():
        out = F.when(how == name, value).otherwise(out)
    return out
