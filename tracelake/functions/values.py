"""Scalar functions as column expressions: times, addresses, identifiers, enumerations, typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1970 to the epochs of 2001 and 1601.
COCOA, WEBKIT = 978_307_200, -11_644_473_600
#: Microseconds: [1970-01-01, 2100-01-01).
MIN_US, MAX_US = 0, 4_102_444_800_000_000


def plausible(us: Column) -> Column:
    return F.when((us >= MIN_US) & (us < MAX_US), us)


def floor_div(v: Column, by: int) -> Column:
    """Whole division towards minus infinity, exact for all integers, as a double isn't."""
    return F.call_function("div", v - F.pmod(v, F.lit(by)), F.lit(by))


def unix_us(v: Column, unit: str) -> Column:
    """Microseconds of a Unix time in s, ms, us or ns; null for sentinels (0, -1, the extremes) and implausible times."""
    bad = is_sentinel(v)
    scale = {"s": v * 1_000_000, "ms": v * 1000, "us": v, "ns": floor_div(v, 1000)}[unit]
    limit = {"s": 1 << 40, "ms": 1 << 50, "us": 1 << 62, "ns": 1 << 62}[unit]
    return F.when(~bad & (F.abs(v) < limit), plausible(scale.cast("bigint")))


def webkit_us(v: Column) -> Column:
    return F.when(~v.isin(0, -1), plausible(v + WEBKIT * 1_000_000))


def cocoa_auto_us(v: Column) -> Column:
    """Seconds, or nanoseconds from 1e11 on, since 2001."""
    us = F.when(F.abs(v) >= 100_000_000_000, floor_div(v.try_cast("bigint"), 1000)).otherwise(v * 1_000_000)
    return F.when(~v.isin(0, -1), plausible((us + COCOA * 1_000_000).cast("bigint")))


def is_sentinel(v: Column) -> Column:
    """Numbers that stand for no time: 0, -1 and the extremes of 64 bits."""
    return v.isin(0, -1, (1 << 63) - 1) | (v == F.expr("-9223372036854775807L - 1"))


def time_class(v: Column, us: Column) -> Column:
    return F.when(is_sentinel(v), "sentinel").when(us.isNull(), "invalid").otherwise("valid")


def address_kind(a: Column) -> Column:
    """email, phone, shortcode, alnum or unknown, in that order."""
    digits = F.length(F.regexp_replace(a, "[^0-9]", ""))
    ip = a.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    day = a.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return (
        F.when(a.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email")
        .when(a.rlike(r"^\+?[0-9 ().\-]+$") & digits.between(7, 15) & ~ip & ~day, "phone")
        .when(a.rlike("^[0-9]{3,6}$"), "shortcode")
        .when(a.rlike("^[A-Za-z0-9 ]{1,11}$"), "alnum")
        .otherwise("unknown")
    )


def jid_parts(j: Column) -> Column:
    """user, device, server of user[:device]@server; the last @ counts."""
    user = F.regexp_extract(j, "^(.*)@([^@]*)$", 1)
    return F.struct(F.regexp_replace(user, ":[0-9]+$", "").alias("user"), F.try_to_number(F.nullif(F.regexp_extract(user, ":([0-9]{1,5})$", 1), F.lit("")), F.lit("99999")).cast("int").alias("device"), F.regexp_extract(j, "^(.*)@([^@]*)$", 2).alias("server"))


def displayed(us: Column, basis: str | Column, offset_minutes: Column) -> Column:
    """A time to the microsecond, in a session of UTC, with Z, ~local (a clock of unknown zone), or ~local and its offset."""
    basis = F.lit(basis) if isinstance(basis, str) else basis
    away = F.abs(offset_minutes)
    zone = F.concat(F.when(offset_minutes < 0, "-").otherwise("+"), F.lpad(F.floor(away / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(away, F.lit(60)).cast("string"), 2, "0"))
    tail = F.when(basis == "utc", "Z").when(basis == "offset", F.concat(F.lit("~local"), zone)).otherwise("~local")
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS"), tail)


SMS_DIRECTIONS = {1: "in", 2: "out", 3: "draft", 4: "out", 5: "out", 6: "out"}
CALL_OUTCOMES = {1: "answered", 2: "answered", 3: "missed", 4: "voicemail", 5: "rejected", 6: "blocked", 7: "answered"}
TRANSITIONS = ("link", "typed", "auto_bookmark", "auto_subframe", "manual_subframe", "generated", "auto_toplevel", "form_submit", "reload", "keyword", "keyword_generated")


def named(v: Column, names: dict[int, str]) -> Column:
    out = F.lit("unknown")
    for k, name in names.items():
        out = F.when(v == k, name).otherwise(out)
    return out


def call_outcome(kind: Column, duration: Column) -> Column:
    return F.when((kind == 2) & (duration == 0), "cancelled").otherwise(named(kind, CALL_OUTCOMES))


def transition_core(v: Column) -> Column:
    return named(v.bitwiseAND(0xFF), dict(enumerate(TRANSITIONS)))


def affinity(declared: Column) -> Column:
    d = F.upper(F.coalesce(declared, F.lit("")))
    return F.when(d.contains("INT"), "INTEGER").when(d.contains("CHAR") | d.contains("CLOB") | d.contains("TEXT"), "TEXT").when(d.contains("BLOB") | (d == ""), "BLOB").when(d.contains("REAL") | d.contains("FLOA") | d.contains("DOUB"), "REAL").otherwise("NUMERIC")


#: Base confidence of a recovered row by method, and caps by the basis of its table.
METHODS = {"wal-prior": 75, "journal-before": 70, "freelist": 60, "wal-stale": 55, "wal-uncommitted": 45, "journal-rolledback": 45, "journal-persist": 35, "page-slack": 25}
CAPS = {"schema": 100, "fit": 60, "guess": 40, "none": 30}


def confidence(method: Column, basis: Column) -> Column:
    pick = lambda c, m: F.coalesce(*[F.when(c == k, v) for k, v in m.items()])
    return F.least(pick(method, METHODS), pick(basis, CAPS))


def band(c: Column) -> Column:
    return F.when(c >= 70, "high").when(c >= 40, "medium").when(c.isNotNull(), "low")


#: Classes of addresses by server.
JID_CLASSES = {"s.whatsapp.net": "user", "g.us": "group", "broadcast": "broadcast", "lid": "lid", "newsletter": "newsletter"}


def jid(j: Column) -> Column:
    """struct(state, user, agent, device, server, class) of user[.agent][:device]@server; an agent only before a device.

    state: ok, no-server, empty-user, empty-server or bad-suffix (a device above 65535, an agent above 255, or no number).
    """
    raw, server = F.regexp_extract(j, "(?s)^(.*)@([^@]*)$", 1), F.regexp_extract(j, "(?s)^(.*)@([^@]*)$", 2)
    has_device = F.contains(raw, F.lit(":"))
    device_text = F.substring_index(raw, ":", -1)
    front = F.when(has_device, F.substring(raw, F.lit(1), F.length(raw) - F.length(device_text) - 1)).otherwise(raw)
    has_agent = has_device & F.contains(front, F.lit("."))
    agent_text = F.substring_index(front, ".", -1)
    user = F.when(has_agent, F.substring(front, F.lit(1), F.length(front) - F.length(agent_text) - 1)).otherwise(front)
    number = lambda t, most: F.when(t.rlike("^[0-9]{1,9}$") & (t.try_cast("int") <= most), t.try_cast("int"))
    device, agent = number(device_text, 65_535), number(agent_text, 255)
    state = (
        F.when(~F.contains(j, F.lit("@")), "no-server").when(raw == "", "empty-user").when(server == "", "empty-server")
        .when((has_device & device.isNull()) | (has_agent & agent.isNull()), "bad-suffix").when(user == "", "empty-user").when(j.isNotNull(), "ok")
    )
    kind = F.lit("other")
    for name, value in JID_CLASSES.items():
        kind = F.when(server == name, value).otherwise(kind)
    kind = F.when((server == "broadcast") & (user == "status"), "status").otherwise(kind)
    ok = lambda c: F.when(state == "ok", c)
    return F.struct(state.alias("state"), ok(user).alias("user"), ok(F.when(has_agent, agent)).alias("agent"), ok(F.when(has_device, device)).alias("device"), ok(server).alias("server"), ok(kind).alias("class"))


def cocoa_auto(v: Column) -> Column:
    """struct(us, unit, class): the time, the unit that its size tells (also where it is out of range), and valid, sentinel or invalid."""
    us = cocoa_auto_us(v)
    return F.struct(us.alias("us"), F.when(F.abs(v) >= 100_000_000_000, "ns").when(v.isNotNull(), "s").alias("unit"), time_class(v, us).alias("class"))
