"""Carving files from long values: one automaton over all signatures, windows that grow as a file's structure asks, nesting.

Values are cut into chunks that overlap by what a header needs, so a value of any length is many tasks' work; tables that hold
values as chunks come as they are. One pass over the chunks finds the headers of all rules at once. Each header then reads its
window: the chunks behind it, as many as its structure needs. Windows begin small, and only those of files that aren't through
grow, so a header that is none costs little. What a file is worth follows from how its end is known (``CONFIDENCE``):

* validated: its structure was walked to its end;
* footer: a mark ends it;
* bounded: it begins as it should, and the value, or the most that the rule allows, ends first.

A header whose structure is wrong is rejected. Files inside files are told with the start of the one around them.

Defined cases: null and empty values have no files; finds of a value are in order of their start; repeated keys are one value
each only if they differ, so keys must be unique; windows beyond ``MOST_WINDOW`` bytes are bounded, not walked.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.staging import staged

OVERLAP = 64
WINDOWS = (1 << 16, 1 << 20, 1 << 24, 1 << 28)
MOST_WINDOW = WINDOWS[-1]
CONFIDENCE = {"validated": 70, "footer": 50, "bounded": 25}


@dataclass(frozen=True)
class Rule:
    """A kind of file: patterns (offset, bytes, mask or none), how its end is found, its least and most bytes, and its alignment."""

    name: str
    patterns: tuple[tuple[int, bytes, bytes | None], ...]
    walk: str | None = None
    footer: bytes = b""
    least: int = 1
    most: int = 1 << 30
    align: int = 1

    def __post_init__(self):
        if not self.patterns or any(not b or (m is not None and len(m) != len(b)) or o < 0 or o + len(b) > OVERLAP for o, b, m in self.patterns):
            raise ValueError(f"{self.name}: patterns need bytes, masks of their length, and must lie in the first {OVERLAP} bytes")
        if self.walk is not None and self.walk not in WALKS:
            raise ValueError(f"{self.name}: no walk {self.walk}")


def rules_of(text: str) -> tuple[Rule, ...]:
    """Rules from JSON: [{"name", "headers": [{"offset", "hex", "mask"}], "footer", "min_len", "max_len", "validate", "align"}]."""
    out = []
    for x in json.loads(text):
        if unknown := set(x) - {"name", "headers", "footer", "min_len", "max_len", "validate", "align"}:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        heads = tuple((h.get("offset", 0), bytes.fromhex(h["hex"]), bytes.fromhex(h["mask"]) if h.get("mask") else None) for h in x["headers"])
        out.append(Rule(x["name"], heads, x.get("validate") or None, bytes.fromhex(x.get("footer", "")), x.get("min_len", 1), x.get("max_len", 1 << 30), x.get("align", 1)))
    return tuple(out)


class More(Exception):
    """The structure goes on behind the window."""


class Bad(Exception):
    """The structure is wrong."""


class Bytes:
    """A window on a file; reading behind its end asks for more, unless the value itself ends there."""

    def __init__(self, data: bytes):
        self.data = data

    def at(self, i: int, n: int) -> bytes:
        if i < 0 or n < 0:
            raise Bad
        if i + n > len(self.data):
            raise More
        return self.data[i : i + n]

    def number(self, i: int, form: str) -> int:
        return struct.unpack(form, self.at(i, struct.calcsize(form)))[0]

    def find(self, what: bytes, i: int) -> int:
        if (k := self.data.find(what, i)) < 0:
            raise More
        return k


# Each walk gives the length of the file, or raises More or Bad.


def _png(b: Bytes) -> int:
    i, first = 8, True
    while True:
        n, kind = b.number(i, ">I"), b.at(i + 4, 4)
        if not kind.isalpha() or n > 1 << 31 or (first and kind != b"IHDR"):
            raise Bad
        if zlib.crc32(b.at(i + 4, n + 4)) != b.number(i + 8 + n, ">I"):
            raise Bad
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i


def _jpeg(b: Bytes) -> int:
    i = 2
    while True:
        mark, kind = b.at(i, 2)
        if mark != 0xFF or kind in (0x00, 0xD8):
            raise Bad
        if kind == 0xD9:
            return i + 2
        n = b.number(i + 2, ">H")
        if n < 2:
            raise Bad
        i += 2 + n
        if kind == 0xDA:  # the scan's own bytes go on to the next mark that isn't part of it
            while True:
                i = b.find(b"\xff", i)
                if b.at(i + 1, 1)[0] not in (0x00, 0xFF, *range(0xD0, 0xD8)):
                    break
                i += 1 if b.at(i + 1, 1) == b"\xff" else 2


def _gif(b: Bytes) -> int:
    if b.at(4, 2) not in (b"7a", b"9a"):
        raise Bad
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    i = 13 + table(b.at(10, 1)[0])
    while True:
        kind = b.at(i, 1)
        if kind == b";":
            return i + 1
        if kind == b",":
            i += 10 + table(b.at(i + 9, 1)[0]) + 1
        elif kind == b"!":
            i += 2
        else:
            raise Bad
        while n := b.at(i, 1)[0]:
            i += n + 1
        i += 1


def _riff(b: Bytes) -> int:
    n = b.number(4, "<I") + 8
    b.at(0, n)
    return n + (n & 1)


#: Boxes of the top level.
BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"meta", b"moof", b"mfra", b"uuid", b"pdin", b"sidx", b"ssix", b"styp", b"pnot", b"udta", b"JXL ", b"jxlc", b"jxlp", b"jxli", b"brob", b"Exif", b"xml ", b"emsg", b"prft"}


def _boxes(b: Bytes) -> int:
    i, seen = 0, 0
    while True:
        try:
            n, kind = b.number(i, ">I"), b.at(i + 4, 4)
        except More:
            if seen > 1 and i == len(b.data):
                return i
            raise
        if kind not in BOXES:
            if seen > 1:
                return i
            raise Bad
        n = b.number(i + 8, ">Q") if n == 1 else n
        if n < 8:
            raise Bad
        i, seen = i + n, seen + 1
        if i > len(b.data):
            raise More


def _sqlite(b: Bytes) -> int:
    page, pages = b.number(16, ">H"), b.number(28, ">I")
    page = 1 << 16 if page == 1 else page
    if page < 512 or page & (page - 1) or not pages or b.at(21, 3) != bytes((64, 32, 32)):
        raise Bad
    b.at(0, page * pages)
    return page * pages


def _bplist(b: Bytes) -> int:
    i = 8
    while True:  # the trailer says where the table before it begins, how wide its entries are and how many
        i = b.find(b"\0\0\0\0\0", i)
        wide, ref, count, top, table = struct.unpack(">BBQQQ", b.at(i + 6, 26))
        if 0 < wide <= 8 and 0 < ref <= 8 and count and top < count and table >= 9 and table + wide * count == i:
            return i + 32
        i += 1


def _zip(b: Bytes) -> int:
    i = 0
    while True:  # the end record says where its directory begins and how long it is
        i = b.find(b"PK\x05\x06", i)
        size, at, comment = struct.unpack("<IIH", b.at(i + 12, 10))
        if at + size == i and (not size or b.at(at, 4) == b"PK\x01\x02"):
            b.at(i, 22 + comment)
            return i + 22 + comment
        i += 1


def _gzip(b: Bytes) -> int:
    d = zlib.decompressobj(31)
    try:
        for i in range(0, len(b.data), 1 << 16):
            d.decompress(b.data[i : i + (1 << 16)])
            if d.eof:
                return min(len(b.data), i + (1 << 16)) - len(d.unused_data)
    except zlib.error:
        raise Bad from None
    raise More


def _ogg(b: Bytes) -> int:
    i = 0
    while True:
        if b.at(i, 5) != b"OggS\0":
            raise Bad
        flags, n = b.at(i + 5, 1)[0], b.at(i + 26, 1)[0]
        i += 27 + n + sum(b.at(i + 27, n))
        b.at(i, 0)
        if flags & 4:
            return i


def _bmp(b: Bytes) -> int:
    n, unused, start, head = b.number(2, "<I"), b.number(6, "<I"), b.number(10, "<I"), b.number(14, "<I")
    if unused or head not in (12, 40, 52, 56, 64, 108, 124) or start < 14 + head or n < start:
        raise Bad
    b.at(0, n)
    return n


def _tiff(b: Bytes) -> int:
    way = "<" if b.at(0, 1) == b"I" else ">"
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    if b.number(2, f"{way}H") == 43:
        raise Bad
    end, at, seen = 8, b.number(4, f"{way}I"), set()
    while at:
        if at in seen or at < 8:
            raise Bad
        seen.add(at)
        n, parts = b.number(at, f"{way}H"), {}
        for i in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack(f"{way}HHI", b.at(i, 8))
            if kind not in size:
                raise Bad
            where = i + 8 if size[kind] * count <= 4 else b.number(i + 8, f"{way}I")
            end = max(end, where + size[kind] * count)
            if tag in (273, 279, 324, 325) and count < 1 << 16:
                form = {3: "H", 4: "I"}.get(kind)
                parts[tag] = struct.unpack(f"{way}{count}{form}", b.at(where, size[kind] * count)) if form else ()
        for offsets, lengths in ((273, 279), (324, 325)):
            end = max([end, *(a + z for a, z in zip(parts.get(offsets, ()), parts.get(lengths, ())))])
        end, at = max(end, at + 2 + 12 * n + 4), b.number(at + 2 + 12 * n, f"{way}I")
    b.at(0, end)
    return end


def _ico(b: Bytes) -> int:
    n = b.number(4, "<H")
    if not n or n > 512:
        raise Bad
    end = 6 + 16 * n
    for i in range(6, 6 + 16 * n, 16):
        zero, size, at = b.at(i + 3, 1)[0], b.number(i + 8, "<I"), b.number(i + 12, "<I")
        if zero or at < 6 + 16 * n or not size:
            raise Bad
        end = max(end, at + size)
    b.at(0, end)
    return end


WALKS: dict[str, Callable[[Bytes], int]] = {
    "png": _png, "jpeg": _jpeg, "gif": _gif, "riff": _riff, "boxes": _boxes, "sqlite": _sqlite, "bplist": _bplist, "zip": _zip, "gzip": _gzip, "ogg": _ogg, "bmp": _bmp, "tiff": _tiff, "ico": _ico,
}


def _head(*b: tuple[int, bytes]) -> tuple[tuple[int, bytes, None], ...]:
    return tuple((o, x, None) for o, x in b)


#: Headers, footers and sizes of the kinds of files.
RULES = (
    Rule("jpeg", _head((0, b"\xff\xd8\xff")), "jpeg", least=64, most=1 << 27),
    Rule("png", _head((0, b"\x89PNG\r\n\x1a\n")), "png", least=57, most=1 << 26),
    Rule("gif", _head((0, b"GIF8")), "gif", least=26, most=1 << 25),
    Rule("webp", _head((0, b"RIFF"), (8, b"WEBP")), "riff", least=26, most=1 << 26),
    Rule("wav", _head((0, b"RIFF"), (8, b"WAVE")), "riff", least=44),
    Rule("isobmff", _head((4, b"ftyp")), "boxes", least=24, most=1 << 32),
    Rule("isobmff", _head((0, b"\0\0\0\x0cJXL \r\n\x87\n")), "boxes", least=24, most=1 << 32),
    Rule("sqlite", _head((0, b"SQLite format 3\0")), "sqlite", least=512),
    Rule("bplist", _head((0, b"bplist00")), "bplist", least=42, most=1 << 24),
    Rule("zip", _head((0, b"PK\x03\x04")), "zip", least=64),
    Rule("pdf", _head((0, b"%PDF-")), footer=b"%%EOF", least=32, most=1 << 29),
    Rule("gzip", _head((0, b"\x1f\x8b\x08")), "gzip", least=18, most=1 << 26),
    Rule("ogg", _head((0, b"OggS\0")), "ogg", least=28, most=1 << 28),
    Rule("bmp", _head((0, b"BM")), "bmp", least=30),
    *[Rule("tiff", _head((0, h)), "tiff", least=32) for h in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+", b"IIRO", b"IIRS", b"MMOR", b"IIU\0")],
    Rule("ico", _head((0, b"\0\0\x01\0")), "ico", least=34, most=1 << 24),
    Rule("cur", _head((0, b"\0\0\x02\0")), "ico", least=34, most=1 << 24),
)


def automaton(rules: tuple[Rule, ...]) -> re.Pattern[bytes]:
    """One expression that matches where a header begins, with a group for each rule."""

    def byte(b: int, mask: int) -> bytes:
        return re.escape(bytes((b,))) if mask == 255 else b"[" + b"".join(re.escape(bytes((x,))) for x in range(256) if x & mask == b & mask) + b"]"

    out = []
    for n, r in enumerate(rules):
        parts, at = b"", 0
        for o, x, m in sorted(r.patterns):
            parts += b"." * (o - at) + b"".join(byte(c, k) for c, k in zip(x, m or b"\xff" * len(x)))
            at = o + len(x)
        out.append(b"(?P<r%d>%s)" % (n, parts))
    return re.compile(b"(?=" + b"|".join(out) + b")", re.DOTALL)


def chunked(blobs: DataFrame, key: str, data: str, size: int = 1 << 20) -> DataFrame:
    """key, at, data: values in chunks of that many bytes, in order."""
    b = F.col(data).cast("binary")
    some = blobs.where(F.octet_length(b) > 0)
    cut = some.select(F.col(key).alias("key"), b.alias("_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.octet_length(b) - 1).cast("bigint"), F.lit(size).cast("bigint"))).alias("at"))
    return cut.select("key", "at", F.substring("_b", F.col("at").cast("int") + 1, F.lit(size)).alias("data"))


def headers(chunks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, start, rule of every header; headers may lie across two chunks."""
    after = chunks.select(F.col("key").alias("_key"), F.col("at").alias("_after"), F.substring("data", 1, OVERLAP).alias("_next"))
    whole = chunks.join(after, (F.col("key") == F.col("_key")) & (F.col("at") + F.octet_length("data") == F.col("_after")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(rules)
        for b in batches:
            row, start, rule = [], [], []
            for i, (at, data, after) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3))):
                own = data.as_py()
                for m in found.finditer(own + (after.as_py() or b"")):
                    if m.start() >= len(own):
                        break
                    r = int(m.lastgroup[1:])
                    if (at + m.start()) % rules[r].align == 0:
                        row.append(i), start.append(at + m.start()), rule.append(r)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(rule, pa.int32())], ["key", "start", "rule"])

    schema = chunks.select("key").schema.add("start", "long").add("rule", "integer")
    return whole.select("key", "at", "data", "_next").mapInArrow(run, schema)


def verdict(data: bytes, rule: Rule, ends: bool, last: bool) -> tuple[str, int]:
    """Outcome and length of a header's window. ends: the value ends with it; last: no larger window is to come.

    outcome: validated, footer, bounded, rejected, or more.
    """
    over = ends or last or len(data) >= rule.most
    if rule.walk:
        try:
            n = WALKS[rule.walk](Bytes(data[: rule.most]))
            return ("validated", n) if n >= rule.least and n <= len(data) else ("rejected", 0)
        except (Bad, struct.error):
            return "rejected", 0
        except More:
            pass
    if rule.footer:
        last_at = data.rfind(rule.footer, 0, rule.most)
        again = data.find(rule.patterns[0][1], 1)  # the next file of that kind
        if again > 0:
            last_at, over = data.rfind(rule.footer, 0, again), True
        if over and last_at > 0:
            n = last_at + len(rule.footer)
            return ("footer", n) if n >= rule.least else ("rejected", 0)
    n = min(len(data), rule.most)
    return ("bounded", n) if over and n >= rule.least else ("rejected", 0) if over else ("more", 0)


def carve(chunks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, name, start, length, outcome, confidence, inside (start of the smallest file around it, or null) of what chunks (key, at, data) hold."""
    chunks = staged(chunks, "carve-chunks")
    sizes = chunks.groupBy("key").agg(F.max(F.col("at") + F.octet_length("data")).alias("_size"))
    open_ = staged(headers(chunks, rules).join(sizes, "key"), "carve-headers")
    schema = chunks.select("key").schema.add("start", "long").add("rule", "integer").add("_size", "long").add("outcome", "string").add("length", "long")
    longest = chunks.agg(F.max(F.octet_length("data"))).first()[0] or 1
    done = None
    for window in WINDOWS:
        # A window's chunks by the numbers of the grid that chunks begin on or near: those that it overlaps.
        step = max(longest, window // 16)
        grid = chunks.select("key", "at", "data", F.explode(F.sequence(F.floor(F.col("at") / step), F.floor((F.col("at") + F.octet_length("data") - 1) / step))).alias("_g"))
        want = open_.select("key", "start", "rule", "_size", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.least(F.col("start") + window, F.col("_size")) - 1) / step))).alias("_g"))
        parts = want.join(grid, ["key", "_g"]).where((F.col("at") < F.col("start") + window) & (F.col("at") + F.octet_length("data") > F.col("start"))).drop("_g").dropDuplicates(["key", "start", "rule", "at"])
        if open_.isEmpty():
            break
        judged = parts.groupBy("key", "start", "rule").applyInArrow(_judge(rules, window), schema)
        judged = staged(judged, "carve-judged")
        done = judged if done is None else done.unionByName(judged)
        open_ = judged.where("outcome = 'more'").select("key", "start", "rule", "_size")
    if done is None:
        done = chunks.limit(0).select("key", F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("rule"), F.lit(0).cast("bigint").alias("_size"), F.lit("").alias("outcome"), F.lit(0).cast("bigint").alias("length"))
    found = done.where(F.col("outcome").isin(*CONFIDENCE))
    name = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("rule") + 1)
    worth = F.element_at(F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p]), F.col("outcome"))
    # The files of a value that are still open where this one begins and end behind it; the last of these is the smallest.
    before = Window.partitionBy("key").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    around = F.array_max(F.transform(F.filter(F.collect_list(F.when(F.col("outcome") != "bounded", F.struct("start", (F.col("start") + F.col("length")).alias("end")))).over(before), lambda x: x["end"] >= F.col("start") + F.col("length")), lambda x: x["start"]))
    return found.select("key", name.alias("name"), "start", "length", "outcome", worth.alias("confidence"), around.alias("inside"))


def _judge(rules: tuple[Rule, ...], window: int):
    def run(parts: pa.Table) -> pa.Table:
        start, rule, size = (parts.column(c)[0].as_py() for c in ("start", "rule", "_size"))
        rows = sorted(zip(parts.column("at").to_pylist(), range(len(parts))))
        data = b"".join(parts.column("data")[i].as_py() for _, i in rows)[start - rows[0][0] :][:window]
        outcome, length = verdict(data, rules[rule], start + len(data) >= size, window == WINDOWS[-1])
        one = parts.slice(0, 1)
        return pa.table([one.column("key"), pa.array([start], pa.int64()), pa.array([rule], pa.int32()), pa.array([size], pa.int64()), pa.array([outcome]), pa.array([length], pa.int64())], names=["key", "start", "rule", "_size", "outcome", "length"])

    return run
