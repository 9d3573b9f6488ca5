"""Outcomes of key joins against plain loops over mixed kinds, classes and collations."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from tracelake.operators import keyjoin as kj

VALUES = [None, float("nan"), 1, 1.0, -3, 2.5, 2**60, float(2**60), "1", " 1 ", "1.0", "2.5", "x", "X", "x ", "x\0a", "X\0b", "12345678901234567890", "1e400", "", b"1", b"x", -0.0, 0, "0"]
CELL = "struct<i: bigint, r: double, t: string, b: binary>"


def cell(v):
    return (v if isinstance(v, int) else None, v if isinstance(v, float) else None, v if isinstance(v, str) else None, bytearray(v) if isinstance(v, bytes) else None)


def number(t):
    """The number that a text reads as, None if it reads as none, ... if not exactly."""
    s = t.strip(" ")
    if re.fullmatch(r"[+-]?\d+", s) and len(re.sub(r"\D", "", s)) <= 18:
        return int(s)
    if m := re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s):
        power = int(m[2][1:]) if m[2] else 0
        return float(s) if len(re.sub(r"\D", "", m[1])) <= 15 and abs(power) <= 22 else ...
    return None


def key(v, collation):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)):
        return ("n", int(v) if float(v).is_integer() else v)
    if isinstance(v, str):
        if collation == "nocase":
            low = re.sub("[A-Z]", lambda m: m[0].lower(), v)
            return ("t", low[: low.find("\0") + 1] if "\0" in low else low, len(v.encode()))
        return ("t", v.rstrip(" ") if collation == "rtrim" else v)
    return ("b", v)


def plain(probe, build, on, to):
    """(hits, outcome, short) of each (value, state)."""
    inexact = sum(s is None and isinstance(v, str) and number(v) is ... for v, s in build)
    unknown = sum(s is not None for _, s in build)
    out = []
    for v, s in probe:
        fits, alt = s is None, on.kind == "numeric" and to.kind != "numeric" and isinstance(v, (int, float))
        w = v
        if to.kind == "numeric" and on.kind != "numeric" and isinstance(v, str) and (n := number(v)) is not None:
            fits, w = fits and n is not ..., n
        if to.kind == "text" and on.kind == "literal":
            fits = fits and not (isinstance(v, float) and not math.isnan(v))
            w = str(v) if isinstance(v, int) else v
        if s is None and key(v, "binary") is None:
            out.append((0, "none", False))
            continue
        if not fits:
            out.append((0, "undecided", False))
            continue
        k = key(w, to.collation)
        hits = sum(t is None and (key(x, to.collation) == k or (alt and isinstance(x, str) and number(x) not in (None, ...) and key(number(x), "binary") == k)) for x, t in build)
        open_ = unknown > 0 or (alt and inexact > 0)
        out.append((hits, "match" if hits else "undecided" if open_ else "miss", bool(hits) and open_))
    return out


@pytest.mark.parametrize("unread, odd", [(False, True), (True, False)])
def test_against_plain_loops(spark, unread, odd):
    probe = [(v, None) for v in VALUES] + [(None, "unread"), ("x", "clipped")]
    build = [(v, None) for v in VALUES if odd or not (isinstance(v, str) and number(v) is ...)] + [(None, "unread")] * unread
    schema = f"id int, c {CELL}, s string"
    p = spark.createDataFrame([(i, cell(v), s) for i, (v, s) in enumerate(probe)], schema)
    b = spark.createDataFrame([(i, cell(v), s) for i, (v, s) in enumerate(build)], schema)
    parts = None
    # Each pair of classes once, collations in turn: texts meet under each of them.
    cases = [(own, other, kj.COLLATIONS[i % 3]) for i, (other, own) in enumerate(itertools.product(("numeric", "text", "blob"), kj.CLASSES))]
    for n, (own, other, collation) in enumerate(cases):
        out = kj.outcomes(p, kj.Side("c", "s", own), b, kj.Side("c", "s", other, collation), {"row": "id"}).select(F.lit(n).alias("n"), "id", "hits", "outcome", "short", "row")
        parts = out if parts is None else parts.unionAll(out)
    got = {(r["n"], r["id"]): (r["hits"], r["outcome"], r["short"]) for r in parts.collect()}
    for n, (own, other, collation) in enumerate(cases):
        want = plain(probe, build, kj.Side("c", "s", own), kj.Side("c", "s", other, collation))
        assert [got[n, i] for i in range(len(probe))] == want, cases[n]


def test_lost_rows_and_report(spark):
    schema = f"id int, c {CELL}, s string"
    p = spark.createDataFrame([(i, cell(v), None) for i, v in enumerate([1, 2, 3, None])], schema)
    b = spark.createDataFrame([(1, cell(1), None), (2, cell(1), None), (3, cell(2), None), (4, cell(None), None)], schema)
    on, to = kj.Side("c", "s", "numeric"), kj.Side("c", "s", "numeric", "nocase")
    rows = {r["id"]: (r["outcome"], r["hits"], r["row"], r["short"]) for r in kj.outcomes(p, on, b, to, {"row": "id"}, lost=1).collect()}
    assert rows == {0: ("match", 2, None, True), 1: ("match", 1, 3, True), 2: ("undecided", 0, None, False), 3: ("none", 0, None, False)}
    r = kj.report(kj.outcomes(p, on, b, to), on, b, to, "t", "c").first()
    assert tuple(r) == ("t", "c", 4, 2, 1, 0, 1, 0, 1, True, False)
    with pytest.raises(ValueError):
        kj.Side("c", None, "numeric", "unicode")


def test_empty_sides(spark):
    empty = spark.createDataFrame([], f"id int, c {CELL}, s string")
    one = spark.createDataFrame([(1, cell(1), None)], empty.schema)
    side = kj.Side("c", "s", "numeric")
    assert [r["outcome"] for r in kj.outcomes(one, side, empty, side).collect()] == ["miss"] and kj.outcomes(empty, side, one, side).count() == 0
