"""Carving: files inside binary values, by signatures that are rows of a list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signature:
    name: str
    header: bytes
    footer: bytes
    max_bytes: int = 1 << 24


#: Formats that end in a footer.
KNOWN = (
    Signature("jpeg", b"\xff\xd8\xff", b"\xff\xd9"),
    Signature("png", b"\x89PNG\r\n\x1a\n", b"IEND\xaeB`\x82"),
    Signature("gif", b"GIF8", b"\x00;"),
    Signature("pdf", b"%PDF-", b"%%EOF"),
)


def spans(data: Column, sig: Signature) -> Column:
    """Array of (signature, start, size): from each header to the first footer within max_bytes; none overlap.

    The value is read as one character for each byte, so that text functions of the JVM search it. A header without a footer
    in range gives nothing. Finds are found left to right: what follows each header up to the next one is its own piece.
    """
    latin = F.decode(data.cast("binary"), "ISO-8859-1")
    h, f = sig.header.decode("latin-1"), sig.footer.decode("latin-1")
    pieces = F.split(latin, "".join(f"\\x{b:02x}" for b in sig.header), -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<signature:string,start:bigint,size:bigint>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        # Before the first piece nothing was found: "at" is where the piece begins, a header's width behind its header.
        end = F.instr(piece, F.lit(f))
        size = (end - 1 + len(h) + len(f)).cast("bigint")
        found = F.struct(F.lit(sig.name).alias("signature"), (acc["at"] - len(h)).cast("bigint").alias("start"), size.alias("size"))
        out = F.when((acc["at"] > 0) & (end > 0) & (size <= sig.max_bytes), F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(piece) + len(h)).cast("bigint").alias("at"), out.alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def carve(blobs: DataFrame, key: str, data: str, signatures: tuple[Signature, ...] = KNOWN) -> DataFrame:
    """key, signature, start, size of every find; null values give none."""
    found = F.flatten(F.array(*[spans(F.coalesce(F.col(data).cast("binary"), F.lit(b"")), s) for s in signatures]))
    return blobs.select(key, F.explode(found).alias("_s")).select(key, "_s.*")
