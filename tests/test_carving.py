"""Files of all kinds in values longer than a chunk, nested, cut off and false."""

import gzip
import io
import json
import struct
import zipfile
import zlib

import pytest

from tracelake.operators import carving as cv


def png(n=40):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", bytes(13)) + part(b"IDAT", bytes(range(256)) * n) + part(b"IEND", b"")


def zipped(inner=b"text " * 30):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.bin", inner)
    return out.getvalue()


def plist():
    body = b"bplist00" + b"\x51a" * 8
    return body + bytes(range(8, 8 + 8)) + b"\0" * 6 + struct.pack(">BBQQQ", 1, 1, 8, 0, len(body))


def tiff(way="<"):
    data, entries = bytes(200), [(273, 4, 1, 8), (279, 4, 1, 200)]
    ifd = struct.pack(f"{way}H", len(entries)) + b"".join(struct.pack(f"{way}HHII", *e) for e in entries) + struct.pack(f"{way}I", 0)
    return (b"II*\0" if way == "<" else b"MM\0*") + struct.pack(f"{way}I", 208) + data + ifd


FILES = {
    "jpeg": b"\xff\xd8\xff\xe0\x00\x10" + bytes(14) + b"\xff\xda\x00\x08" + bytes(6) + b"\x01\xff\x00\x02\xff\xd3" * 20 + b"\xff\xd9",
    "png": png(), "gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"!\xf9\x04\0\0\0\0\0" + b"," + bytes(9) + b"\x02\x03abc\x00;",
    "webp": b"RIFF" + struct.pack("<I", 60) + b"WEBP" + bytes(56), "wav": b"RIFF" + struct.pack("<I", 100) + b"WAVE" + bytes(96),
    "isobmff": struct.pack(">I", 24) + b"ftypisom" + bytes(12) + struct.pack(">I", 50) + b"mdat" + bytes(42),
    "sqlite": b"SQLite format 3\0" + struct.pack(">HBBB3BIII", 512, 1, 1, 0, 64, 32, 32, 0, 3, 0)[:20] + bytes(512 * 3 - 36), "bplist": plist(), "zip": zipped(), "pdf": b"%PDF-1.4\n" + b"x" * 60 + b"\n%%EOF",
    "gzip": gzip.compress(b"some text " * 400), "ogg": b"OggS\0\x02" + bytes(20) + b"\x02\x05\x06" + bytes(11) + b"OggS\0\x04" + bytes(20) + b"\x01\x09" + bytes(9), "bmp": b"BM" + struct.pack("<IIII", 90, 0, 54, 40) + bytes(72),
    "tiff": tiff(), "ico": b"\0\0\x01\0\x01\0" + b"\x10\x10\0\0" + bytes(4) + struct.pack("<II", 80, 22) + b"\x80" * 80, "cur": b"\0\0\x02\0\x01\0" + b"\x10\x10\0\0" + bytes(4) + struct.pack("<II", 80, 22) + b"\x80" * 80,
}


def found(spark, values, chunk=64, rules=cv.RULES):
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in values.items()], "k string, v binary")
    return {(r["key"], r["start"], r["name"]): (r["length"], r["outcome"], r["confidence"], r["inside"]) for r in cv.carve(cv.chunked(df, "k", "v", chunk), rules).collect()}


def test_every_kind_across_chunks(spark):
    """All sixteen kinds with text around them, in chunks much smaller than they are."""
    assert {r.name for r in cv.RULES} == set(FILES) and len(FILES) == 16
    values = {n: b"\x55" * 37 + f + b"\x55" * 50 for n, f in FILES.items()}
    got = found(spark, {**values, "none": None, "empty": b"", "text": b"BM and PK and GIF87 of nothing"})
    for n, f in FILES.items():
        want = (len(f), "footer", 50, None) if n == "pdf" else (len(f), "validated", 70, None)
        assert got[n, 37, n] == want, n
    assert all(x[1] == "bounded" or k[1] != 37 or k[0] == k[2] for k, x in got.items()) and not any(k[0] in ("none", "empty", "text") for k in got)


def test_a_file_longer_than_the_first_windows(spark):
    long = png(6000)
    assert len(long) > cv.WINDOWS[1]
    got = found(spark, {"a": b"x" * 70_001 + long + b"y" * 9}, 100_000)
    assert got == {("a", 70_001, "png"): (len(long), "validated", 70, None)}


def test_nested_cut_and_false(spark):
    inner = png(2)
    outer = zipped(b"q" * 11 + inner)
    at = 5 + outer.index(inner)
    got = found(spark, {"n": b"....." + outer + b"...", "cut": FILES["png"][:-20], "false": b"\x89PNG\r\n\x1a\n" + b"z" * 200, "two": FILES["pdf"] * 2})
    assert got["n", 5, "zip"][:2] == (len(outer), "validated") and got["n", at, "png"] == (len(inner), "validated", 70, 5)
    assert got["cut", 0, "png"][1:3] == ("bounded", 25) and not any(k[0] == "false" for k in got)
    assert [got["two", s, "pdf"][:2] for s in (0, len(FILES["pdf"]))] == [(len(FILES["pdf"]), "footer")] * 2


def test_rules_from_json_with_masks_and_alignment(spark):
    rules = cv.rules_of(json.dumps([{"name": "mine", "headers": [{"hex": "a0b0", "mask": "f0ff"}, {"offset": 3, "hex": "cc"}], "footer": "ee", "min_len": 4, "max_len": 12, "align": 4}]))
    got = found(spark, {"a": bytes.fromhex("a7b000cc0011ee00" + "00a1b000ccee" + "0000" + "a1b000dd")}, 5, rules)
    assert got == {("a", 0, "mine"): (7, "footer", 50, None)}
    for bad in ('[{"name": "x", "headers": []}]', '[{"name": "x", "headers": [{"hex": "00", "mask": "0000"}]}]', '[{"name": "x", "headers": [{"hex": "00"}], "validate": "nothing"}]', '[{"name": "x", "headers": [{"hex": "00"}], "more": 1}]'):
        with pytest.raises(ValueError):
            cv.rules_of(bad)
