"""Payloads as column expressions: canonical JSON, schema checks, cleaned texts, summaries of types, locators, capped lists."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import duration_seconds, summary
from .values import plausible

MAX_PAYLOAD, MAX_DEPTH = 1 << 20, 64


class _Number(str):
    """A number as it was spelt."""


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _string(s: str) -> str:
    return '"' + re.sub(r'["\\\x00-\x1f]', lambda m: _ESCAPES.get(m.group(), f"\\u{ord(m.group()):04x}"), s) + '"'


def canonical_json(text: str | None) -> str | None:
    """Keys in the order of their bytes, numbers as spelt, the fewest escapes, no space; null if it isn't an object, repeats a key or is too large."""

    def pairs(items: list[tuple[str, object]]) -> dict[str, object]:
        if len(dict(items)) < len(items):
            raise ValueError("a key twice")
        return dict(items)

    def written(v: object, depth: int) -> str:
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        if isinstance(v, _Number):
            return str(v)
        if isinstance(v, str):
            return _string(v)
        if isinstance(v, dict):
            return "{" + ",".join(f"{_string(k)}:{written(v[k], depth + 1)}" for k in sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
        if isinstance(v, list):
            return "[" + ",".join(written(x, depth + 1) for x in v) + "]"
        return {None: "null", True: "true", False: "false"}[v]

    def no_constant(_: str) -> None:
        raise ValueError("no number")

    try:
        if text is None or len(text.encode()) > MAX_PAYLOAD:
            return None
        v = json.loads(text, object_pairs_hook=pairs, parse_int=_Number, parse_float=_Number, parse_constant=no_constant)
        return written(v, 1) if isinstance(v, dict) else None
    except (ValueError, RecursionError):
        return None


def canonical(text: Column) -> Column:
    """canonical_json of every payload, in batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical_json(t if isinstance(t, str) else None))

    return F.pandas_udf(run, "string")(text)


@dataclass(frozen=True)
class Field:
    """A field of a payload: string, number (from 0) or bool; one of some values; whether it must be there."""

    name: str
    kind: str = "string"
    values: tuple[str, ...] = ()
    required: bool = False


#: What a message's payload needs, as far as the queries check it.
EXAMPLE = (Field("direction", values=("in", "out"), required=True), Field("body", required=True), Field("n", kind="number"))


def violation(payload: Column, fields: tuple[Field, ...]) -> Column:
    """The first field, in order, that breaks its schema, and how, without its value; null if none does. Unknown fields are allowed."""
    v = F.try_parse_json(payload)
    checks = F.when(payload.isNull() | v.isNull(), "not JSON")
    for f in fields:
        text = F.try_variant_get(v, f"$.{f.name}", "string")
        if f.required:
            checks = checks.when(text.isNull(), f"{f.name}: missing")
        if f.values:
            checks = checks.when(text.isNotNull() & ~text.isin(*f.values), f"{f.name}: not one of {', '.join(f.values)}")
        if f.kind == "number":
            checks = checks.when(text.isNotNull() & (F.coalesce(text.try_cast("double"), F.lit(-1.0)) < 0), f"{f.name}: not a number from 0")
        if f.kind == "bool":
            checks = checks.when(text.isNotNull() & ~text.isin("true", "false"), f"{f.name}: not a truth value")
    return checks


def clean_text(data: Column, limit: int = 1 << 16) -> Column:
    """struct(text, invalid, nul, cut, raw_sha256) of bytes: undecodable bytes and NUL become U+FFFD, cut before limit bytes at a whole character.

    The hash of the bytes as found is there whenever the text isn't them.
    """
    b = data.cast("binary")
    made = F.make_valid_utf8(b.cast("string"))
    invalid, nul = ~F.is_valid_utf8(b.cast("string")), F.contains(made, F.lit("\0"))
    whole = F.replace(made, F.lit("\0"), F.lit("�"))
    cut = F.octet_length(whole) > limit
    # Cut in bytes, then a last character that is only begun goes.
    head = F.regexp_replace(F.make_valid_utf8(F.substring(whole.cast("binary"), 1, limit).cast("string")), "�$", "")
    kept = F.when(~cut, whole).when(F.startswith(whole, F.concat(head, F.lit("�"))) & (F.octet_length(head) + 3 <= limit), F.concat(head, F.lit("�"))).otherwise(head)
    return F.when(b.isNotNull(), F.struct(kept.alias("text"), invalid.alias("invalid"), nul.alias("nul"), cut.alias("cut"), F.when(invalid | nul | cut, F.sha2(b, 256)).alias("raw_sha256")))


def message_summary(channel: Column, direction: Column, party: Column, body: Column) -> Column:
    """channel direction party: the first 80 characters."""
    return F.concat(channel, F.lit(" "), direction, F.lit(" "), F.coalesce(party, F.lit("?")), F.lit(": "), F.coalesce(summary(body, 80), F.lit("")))


def call_summary(kind: Column, direction: Column, party: Column, outcome: Column, seconds: Column) -> Column:
    return F.concat_ws(" ", kind, F.lit("call"), direction, F.coalesce(party, F.lit("?")), outcome, F.when(seconds.isNotNull(), F.concat(seconds.cast("string"), F.lit(" s"))))


def visit_summary(title: Column, url: Column) -> Column:
    return F.concat_ws(" - ", F.nullif(summary(title, 80), F.lit("")), summary(url, 120))


def line(text: Column, limit: int = 80) -> Column:
    """One line of at most limit characters, format characters shown; null for none."""
    return F.nullif(printable(summary(text, limit)), F.lit(""))


def contact_summary(name: Column, phone: Column, email: Column) -> Column:
    """Name and phone, as far as they are there, else the e-mail address."""
    both = F.concat_ws(" ", line(name), line(phone, 32))
    return F.coalesce(F.nullif(both, F.lit("")), line(email), F.lit(""))


def search_summary(term: Column, normalized: Column) -> Column:
    """The query as typed, else its normalised form."""
    return F.coalesce(line(term), line(normalized), F.lit(""))


def download_summary(target: Column, current: Column, url: Column) -> Column:
    """The file's name: the last part of where it goes, else of where it is; else the URL."""
    last = lambda p: F.regexp_extract(p, r"(?s)([^/\\]*)$", 1)
    return F.coalesce(line(last(target)), line(last(current)), line(url), F.lit(""))


def calendar_summary(kind: Column, when: Column, title: Column, place: Column, status: Column) -> Column:
    """calendar, what it is of a series (null: a single event), when, title, @ place, and whether it was cancelled."""
    at = F.concat(F.lit("@ "), line(place, 64))
    return F.concat_ws(" ", F.lit("calendar"), kind, when, line(title, 120), at, F.when(status == "cancelled", "[cancelled]"))


def event_times(start_ms: Column, end_ms: Column, duration: Column, all_day: Column, zone: Column) -> Column:
    """When a stored event begins and ends: struct of timing, start_us, start_date, end_us, end_date, basis, end_basis, state, end_state, conflict, zone_state.

    timing: timed (0), all_day (1), else unknown, which has no times. Timed events are UTC; those of whole days are at midnight of no
    known zone, and have dates; their stored zone is never applied. A stored duration goes before a stored end (conflict: they
    differ); one that doesn't parse leaves the end undecided. end_state: no-start, none-stored, end-before-start, not-midnight.
    """
    timing = F.when(all_day == 0, "timed").when(all_day == 1, "all_day").otherwise("unknown")
    day = 86_400_000
    start_ok = (timing != "unknown") & start_ms.isNotNull() & plausible(start_ms * 1000).isNotNull()
    midnight = lambda ms: F.pmod(ms, F.lit(day)) == 0
    begins = start_ok & ((timing == "timed") | midnight(start_ms))
    parsed = duration_seconds(duration)
    wrong = duration.isNotNull() & (parsed["state"] != "ok")
    by_duration = F.when(duration.isNotNull() & (parsed["state"] == "ok"), start_ms + parsed["seconds"] * 1000)
    end = F.when(~wrong, F.coalesce(by_duration, end_ms))
    end_state = (
        F.when(timing == "unknown", None).when(~F.coalesce(begins, F.lit(False)), "no-start").when(wrong, None).when(end.isNull(), "none-stored").when(end < start_ms, "end-before-start")
        .when(plausible(end * 1000).isNull(), "out-of-range").when((timing == "all_day") & ~midnight(end), "not-midnight")
    )
    ends = F.coalesce(begins, F.lit(False)) & ~wrong & end.isNotNull() & end_state.isNull()
    date = lambda ms: F.date_from_unix_date(F.floor(ms / day).cast("int")).cast("string")
    whole = timing == "all_day"
    return F.struct(
        timing.alias("timing"), F.when(begins, start_ms * 1000).alias("start_us"), F.when(begins & whole, date(start_ms)).alias("start_date"), F.when(ends, end * 1000).alias("end_us"), F.when(ends & whole, date(end)).alias("end_date"),
        F.when(begins, F.when(whole, "local-unknown").otherwise("utc")).alias("basis"), F.when(ends, F.when(by_duration.isNotNull(), "duration").otherwise("dtend")).alias("end_basis"), F.when(start_ok & ~begins, "not-midnight").alias("state"),
        end_state.alias("end_state"), F.coalesce(begins & by_duration.isNotNull() & (end_ms != by_duration), F.lit(False)).alias("conflict"), F.when(whole & (zone != "UTC"), "not-utc").alias("zone_state"),
    )


def escaped(part: Column) -> Column:
    """A part of a locator: bytes other than letters, digits and -._~/ as percent and two hexadecimal digits."""
    return F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def locator(scheme: str, parts: Mapping[str, Column]) -> Column:
    """scheme:name=part;name=part; parts that are null are left out."""
    return F.concat(F.lit(f"{scheme}:"), F.concat_ws(";", *[F.concat(F.lit(f"{n}="), escaped(c)) for n, c in parts.items()]))


def recovered_locator(scheme: str, parts: Mapping[str, Column], found: Column) -> Column:
    """A locator of something that isn't where it was: with a digest of the bytes found."""
    return F.concat(locator(scheme, parts), F.lit(";sha256="), F.sha2(found.cast("binary"), 256))


def capped(items: Column, most: int = 1000) -> Column:
    """struct(items, total, truncated) of a list."""
    return F.struct(F.slice(items, 1, most).alias("items"), F.size(items).cast("bigint").alias("total"), (F.size(items) > most).alias("truncated"))


def event_end(start_us: Column, end_us: Column, seconds: Column, all_day: Column) -> Column:
    """struct(end_us, how): the stored end, else the start and the duration, else the next day of an all-day event; none before its start."""
    day = 86_400_000_000
    how = F.when(end_us.isNotNull() & (end_us >= start_us), "stored").when(seconds.isNotNull() & (seconds >= 0), "duration").when(all_day & start_us.isNotNull(), "all-day").otherwise("none")
    end = F.when(how == "stored", end_us).when(how == "duration", start_us + seconds.cast("bigint") * 1_000_000).when(how == "all-day", start_us + day)
    return F.struct(end.cast("bigint").alias("end_us"), how.alias("how"))


def logical_path(path: Column) -> Column:
    """One slash between parts, none at the end, "." left out; null where a part is ".." or the path isn't absolute."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda p: ~p.isin("", "."))
    bad = F.exists(parts, lambda p: p == "..") | ~path.rlike(r"^[/\\]")
    return F.when(~bad, F.concat(F.lit("/"), F.array_join(parts, "/")))


def local_name(name: Column) -> Column:
    """A file name for any system: reserved characters and controls become _, no dot or space at the end, device names get a _ before them."""
    plain = F.regexp_replace(F.regexp_replace(name, r"[<>:\"/\\|?*\x00-\x1f]", "_"), r"[. ]+$", "_")
    device = plain.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$")
    return F.when(plain == "", "_").when(device, F.concat(F.lit("_"), plain)).otherwise(plain)


def printable(text: Column) -> Column:
    """Controls, format characters and separators other than space as <U+XXXX>, so that a terminal shows them."""
    one = lambda c: F.when(c.rlike(r"^[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]$"), F.concat(F.lit("<U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")), 4, "0"), F.lit(">"))).otherwise(c)
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")
