"""Exact substring deduplication with a logarithmic family of suffix indexes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier (in a document of smaller id, or earlier
in its own). Suffixes are sampled where they suffice: the smallest hash of ``GRAM`` bytes in a window of ``LENGTH`` bytes is
its anchor, so equal windows have equal anchors at equal distances. The windows of one anchor form a segment, and a
segment is one entry of a suffix array: the fingerprint of its anchored suffix, that of the whole segment, and the first
place where it is. Arrays are in the order of these fingerprints, not of the bytes: equal suffixes are neighbours in
either order, and nothing else is asked of it.

The family takes batches in the order of documents (``SuffixFamily``). The array of a new batch is made while it is merged
with the arrays of all levels, and this merge scan gives the matches of the batch: entries that are in a level or were
earlier in the batch are copies and go whole; entries that share their anchored suffix with others, in a level or in the
batch, but not the whole segment are matches in part. What is new becomes a level of one batch, and levels of equal size
merge, so that k batches leave no more levels than the digits of k in base two.

Matches in part are extended afterwards, in blocks of ``BLOCK`` windows: a block has a core, the bytes
that all its windows share, and the few bytes on either side of it. Only blocks with an equal core can share a window;
those that are equal throughout go whole but for the first, and single windows are compared for the others alone. So a
passage with thousands of copies is a handful of rows wherever rows meet.

Defined cases: null text is empty; texts shorter than ``LENGTH`` bytes lose nothing; rows of
the same id, or of none, are apart, in the order of their texts' digests; an empty table gives an empty result; null ids
count as the smallest; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix64, random64
from .common import drop_tables, row_keys, scratch, small_batches, stage_table

LENGTH, GRAM = 100, 32
CHUNK = 300_000
#: Windows that share an anchor are compared in blocks of so many; the bytes beside a block's core fit into a long.
BLOCK = 8
CORE = LENGTH - BLOCK + 1
#: 64-bit words of the bitmap that thins suffixes before the exact join; a fixed size.
BITMAP_BITS = 20
#: Entries with more copies in a batch than this are dealt over several tasks; so many entries at most.
HOT, MAX_HOT = 5_000, 50_000

_BYTES, _STEPS, _PARTS = random64(256, 1), random64(8, 2), random64(16, 3)
WIDTH = LENGTH - GRAM + 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, by doubling; shorter by GRAM - 1."""
    h = _BYTES[data]
    size, k = 1, 0
    while size < GRAM:
        h = h[:-size] * _STEPS[k] + h[size:]
        h ^= h >> np.uint64(29)
        size, k = size * 2, k + 1
    return mix64(h)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The least of width values from each position."""
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - size :]) if size < width else m


def batches_of(data: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    first, held, n = 0, [], 0
    for i, b in enumerate(data):
        b = bytes(b) if b is not None else b""
        if held and n + len(b) > CHUNK:
            yield first, held
            first, held, n = i, [], 0
        held.append(b)
        n += len(b)
    if held:
        yield first, held


def segments(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """row, place (see ``places``), anchor hash, segment hash of every run of windows that share an anchor."""
    sizes = np.array([len(b) for b in data], np.int64)
    if sizes.max(initial=0) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    at = np.concatenate(([0], np.cumsum(sizes)))
    g = gram_hashes(np.frombuffer(b"".join(data), np.uint8))
    bits = np.uint64(max(20, int(len(g)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    anchor = (_smallest((g & ~low) | np.arange(len(g), dtype=np.uint64), WIDTH) & low).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    long = sizes >= LENGTH
    np.add.at(valid, at[:-1][long], 1)
    np.add.at(valid, at[1:][long] - LENGTH + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new[at[:-1][long]] = True  # a document that ends where the next begins
    s0 = np.flatnonzero(new)
    total = np.concatenate(([0], np.cumsum(inside)))
    ends = np.concatenate((s0[1:], [len(inside)]))
    n = total[ends] - total[s0]
    s1 = s0 + n - 1
    row = np.searchsorted(at, s0, "right") - 1
    a = anchor[s0]
    seg = mix64(sum((g[p] * _PARTS[i] for i, p in enumerate((s0, s0 + 32, s0 + 64, s1 + 4, s1 + 36, s1 + 68))), n.astype(np.uint64) * _PARTS[8] + (a - s0).astype(np.uint64) * _PARTS[9]))
    return row, places(s0 - at[row], n, a - s0), g[a], seg


def places(start: np.ndarray, n: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """First window of a segment, how many it has, and how far its anchor lies from the first, as one number in text order."""
    return (start << 16) | (n << 8) | ahead


def _of_batch(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """h, seg, doc, place of each segment; n, how often its document has it, at the first of these, else 0."""
    ids = b["_doc"].to_numpy()
    for first, data in batches_of(b["_data"]):
        row, place, h, seg = segments(data)
        _, at, k = np.unique(mix64(h + seg * _PARTS[14] + row.astype(np.uint64) * _PARTS[15]), return_index=True, return_counts=True)
        n = np.zeros(len(row), np.int64)
        n[at] = k
        yield pd.DataFrame({"h": h.view(np.int64), "seg": seg.view(np.int64), "doc": ids[first + row], "place": place, "n": n})


def entries(docs: DataFrame) -> DataFrame:
    """h, seg, doc, place, n of each different segment of documents (_doc, _data): its first place there and how often it is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for out in _of_batch(b):
                yield out[out["n"] > 0]

    return docs.mapInPandas(run, "h bigint, seg bigint, doc bigint, place bigint, n bigint")


def _entry_hash(h: np.ndarray, seg: np.ndarray) -> np.ndarray:
    return mix64(h + seg * _PARTS[14])


def occurrences(docs: DataFrame, bitmap: np.ndarray, hot: pd.DataFrame) -> DataFrame:
    """h, seg, doc, place, first (in its document), part of segments whose h may be in the bitmap; part deals entries in hot (h, seg, parts)."""
    hot_hash = _entry_hash(hot["h"].to_numpy(np.int64).view(np.uint64), hot["seg"].to_numpy(np.int64).view(np.uint64))
    order = np.argsort(hot_hash)
    # One entry more, of no parts to deal, so that there is always one to look at.
    hot_hash, parts = np.append(hot_hash[order], np.uint64(0)), np.append(hot["parts"].to_numpy(np.int64)[order], 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for out in _of_batch(b):
                h = out["h"].to_numpy().view(np.uint64)
                out = out[(bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] >> ((h >> np.uint64(58 - BITMAP_BITS)) & np.uint64(63))) & np.uint64(1) == 1]
                key = _entry_hash(out["h"].to_numpy().view(np.uint64), out["seg"].to_numpy().view(np.uint64))
                at = np.searchsorted(hot_hash[:-1], key)
                dealt = np.where(hot_hash[at] == key, parts[at], 1)
                spread = mix64(out["doc"].to_numpy().view(np.uint64) * _PARTS[15] + out["place"].to_numpy().view(np.uint64))
                yield pd.DataFrame({"h": out["h"], "seg": out["seg"], "doc": out["doc"], "place": out["place"], "first": out["n"] > 0, "part": (spread % dealt.astype(np.uint64)).astype(np.int32)})

    return docs.mapInPandas(run, "h bigint, seg bigint, doc bigint, place bigint, first boolean, part int")


class SuffixFamily:
    """Levels of suffix arrays of 1, 2, 4 ... batches; batches come in the order of their documents."""

    def __init__(self) -> None:
        #: (number of batches, h, seg, doc, place of each different segment, in the order of h and seg)
        self.levels: list[tuple[int, DataFrame]] = []

    def _held(self) -> DataFrame | None:
        held = None
        for _, level in self.levels:
            held = level if held is None else held.union(level)
        return held

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Adds a batch (_doc, _data); returns its copies (doc, start, stop) and its matches in part (doc, place, both sides)."""
        scan, held = entries(docs), self._held()
        if held is not None:
            none = F.lit(None).cast("bigint")
            scan = scan.union(held.select("h", "seg", none, none, F.lit(0).cast("bigint")))
        # The merge scan: equal entries of the batch and all levels meet once; those of levels alone drop out.
        scan = scan.groupBy("h", "seg").agg(F.min("doc").alias("doc"), F.min_by("place", "doc").alias("place"), F.sum("n").alias("n"), (F.min("n") == 0).alias("old")).where("n > 0")
        array = stage_table(scan.sortWithinPartitions("h", "seg"), "suffix-array")
        copies = stage_table(self._copies(docs, array), "suffix-copies")
        fresh = array.where("NOT old").select("h", "seg", "doc", "place")
        sides = fresh.select("h", F.lit(1).alias("new"))
        sides = sides if held is None else sides.union(held.select("h", F.lit(0).alias("new")))
        several = stage_table(sides.groupBy("h").agg(F.count("*").alias("k"), F.max("new").alias("new")).where("k > 1 AND new = 1").select("h"), "suffix-several")
        part = fresh if held is None else fresh.union(held)
        part = stage_table(part.join(several, "h", "left_semi").select("doc", "place"), "suffix-part")
        drop_tables(several)
        self.levels.append((1, fresh))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, other) = self.levels.pop(), self.levels.pop()
            both = stage_table(other.union(one).repartition("h").sortWithinPartitions("h", "seg"), "suffix-level")
            drop_tables(one, other)
            self.levels.append((2 * size, both))
        return copies, part

    @staticmethod
    def _copies(docs: DataFrame, array: DataFrame) -> DataFrame:
        """Segments of the batch that are not the first of their entry."""
        again = array.where("n > 1 OR old")
        total = array.agg(F.sum("n")).first()[0] or 0
        # Of entries with more than total / MAX_HOT copies there are fewer than MAX_HOT.
        parts = F.when(F.col("n") > max(HOT, total // MAX_HOT), F.ceil(F.col("n") / HOT)).otherwise(1).cast("int")
        hot = again.select("h", "seg", parts.alias("parts")).where("parts > 1").toPandas()
        firsts = again.select("h", "seg", F.when(~F.col("old"), F.col("doc")).alias("_doc"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        found = occurrences(docs, bitmap_of(again.select("h")), hot).join(firsts, ["h", "seg", "part"]).where("_doc IS NULL OR doc != _doc OR NOT first")
        begin, n = F.shiftright("place", 16).cast("int"), F.shiftright("place", 8).bitwiseAND(255).cast("int")
        return found.select("doc", begin.alias("start"), (begin + n + (LENGTH - 1)).alias("stop"))

    def drop(self) -> None:
        """Deletes all levels."""
        drop_tables(*[level for _, level in self.levels])


def bitmap_of(matches: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has every h of matches."""
    words = matches.groupBy(F.shiftrightunsigned("h", 64 - BITMAP_BITS).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {58 - BITMAP_BITS}) & 63 AS int))")).alias("b"))
    out = np.zeros(1 << BITMAP_BITS, np.uint64)
    found = words.toPandas()
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _packed(data: np.ndarray, p: np.ndarray, step: int, n: np.ndarray) -> np.ndarray:
    """The n bytes from p on, in steps of 1 or -1, the first one lowest."""
    out = np.zeros(len(p), np.int64)
    for i in range(BLOCK - 1):
        inside = np.flatnonzero(n > i)
        out[inside] |= data[p[inside] + step * i].astype(np.int64) << (8 * i)
    return out


def blocks_of(data: bytes, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """core, left, right, low, high, p of the blocks of segments in data.

    A window whose anchor is j bytes further in than the block's least has j bytes left of the core and BLOCK - 1 - j right
    of it; the block's windows have j from low to high, and that with high begins at p.
    """
    raw = np.frombuffer(data, np.uint8)
    g = gram_hashes(raw)
    start, n, ahead = place >> 16, (place >> 8) & 255, place & 255
    least = ahead - n + 1
    k = ahead // BLOCK - least // BLOCK + 1
    of = np.repeat(np.arange(len(place)), k)
    q = (least // BLOCK)[of] + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    low, high = np.maximum(least[of] - q * BLOCK, 0), np.minimum(ahead[of] - q * BLOCK, BLOCK - 1)
    at = (start + ahead)[of] - q * BLOCK
    core = mix64(g[at] * _PARTS[10] + g[at + GRAM] * _PARTS[11] + g[at + CORE - GRAM] * _PARTS[12] + q.astype(np.uint64) * _PARTS[13])
    return core.view(np.int64), _packed(raw, at - 1, -1, high), _packed(raw, at + CORE, 1, BLOCK - 1 - low), low, high, at - high


def first_blocks(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """core, l, r, low, high, doc, p of the blocks of the segments in firsts (doc, place)."""
    lists = firsts.groupBy(F.col("doc").alias("_of")).agg(F.collect_list("place").alias("_places"))
    joined = docs.join(lists, docs["_doc"] == lists["_of"]).select("_doc", "_data", "_places")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, listed = b["_doc"].to_numpy(), b["_places"].to_numpy()
            for first, data in batches_of(b["_data"]):
                # The texts of a batch end to end, and segments at their places in it.
                at = np.concatenate(([0], np.cumsum([len(x) for x in data])))
                place = np.concatenate([np.asarray(x, np.int64) + (at[i] << 16) for i, x in enumerate(listed[first : first + len(data)])])
                core, l, r, low, high, p = blocks_of(b"".join(data), place)
                row = np.searchsorted(at, p, "right") - 1
                yield pd.DataFrame({"core": core, "l": l, "r": r, "low": low.astype(np.int8), "high": high.astype(np.int8), "doc": ids[first + row], "p": (p - at[row]).astype(np.int32)})

    return joined.mapInPandas(blocks, "core bigint, l bigint, r bigint, low tinyint, high tinyint, doc bigint, p int")


def _windows_of(blocks: DataFrame) -> DataFrame:
    """core, j, l, r, doc, p of every single window of blocks, l and r cut to the window's bytes."""
    each = blocks.select("core", "l", "r", "doc", "p", "high", F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("j"))
    left, right = F.expr("shiftleft(1L, 8 * j) - 1"), F.expr(f"shiftleft(1L, 8 * ({BLOCK - 1} - j)) - 1")
    return each.select("core", "j", F.col("l").bitwiseAND(left).alias("l"), F.col("r").bitwiseAND(right).alias("r"), "doc", (F.col("p") + F.col("high") - F.col("j")).alias("p"))


def _later(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Firsts (keys, doc, p) of rows that are equal by keys; and all the others."""
    groups = rows.groupBy(*keys).agg(F.min(F.struct("doc", "p")).alias("_first"), F.count("*").alias("_k"))
    others = rows.join(groups.where("_k > 1").drop("_k"), keys).where("doc != _first.doc OR p != _first.p")
    return groups.select(*keys, "_first.*"), others


def _repeated_blocks(blocks: DataFrame) -> DataFrame:
    """doc, start, stop of the windows of blocks, a staged table that is deleted, that start earlier in other blocks."""
    shared = blocks.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    met = stage_table(blocks.join(shared, "core", "left_semi"), "suffix-blocks")
    drop_tables(blocks)
    firsts, others = _later(met, ["core", "l", "r", "low", "high"])
    whole = others.select("doc", F.col("p").alias("start"), (F.col("p") + F.col("high") - F.col("low") + LENGTH).alias("stop"))
    firsts = stage_table(firsts, "suffix-blocks")
    several = firsts.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    _, single = _later(_windows_of(firsts.join(several, "core", "left_semi")), ["core", "j", "l", "r"])
    return whole.union(single.select("doc", F.col("p").alias("start"), (F.col("p") + LENGTH).alias("stop")))


def repeated_spans(docs: DataFrame, batches: int = 4) -> DataFrame:
    """doc, starts, stops: spans of windows that start earlier elsewhere, of documents (_doc, _data); they may overlap."""
    cuts = sorted(set(docs.approxQuantile("_doc", [i / batches for i in range(1, batches)], 0.01)))
    edges = [None, *[int(c) for c in cuts], None]
    with scratch(docs.sparkSession):
        family = SuffixFamily()
        whole, parts = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            batch = docs if lo is None else docs.where(F.col("_doc") > lo)
            copies, part = family.add(batch if hi is None else batch.where(F.col("_doc") <= hi))
            whole.append(copies)
            parts.append(part)
        family.drop()
        blocks = stage_table(first_blocks(docs, reduce(DataFrame.union, parts).distinct()), "suffix-blocks")
        drop_tables(*parts)
        spans = reduce(DataFrame.union, [*whole, _repeated_blocks(blocks)])
        spans = spans.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
        return stage_table(spans, "suffix-spans", kept=True)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row."""
    small_batches(docs.sparkSession)
    keyed, numbered = row_keys(docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")), "_id", "_text", "suffix-rows")
    body = keyed.select("_doc", F.coalesce(F.col("_text").cast("binary"), F.lit(b"")).alias("_data"))
    spans = repeated_spans(body, batches).select(F.col("doc").alias("_of"), F.col("starts").alias("_starts"), F.col("stops").alias("_stops"))
    joined = body.join(spans, body["_doc"] == spans["_of"], "left").select("_doc", "_data", "_starts", "_stops")

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for doc, data, starts, stops in zip(b["_doc"], b["_data"], b["_starts"], b["_stops"], strict=True):
                if starts is None:
                    out.append((doc, len(data), 0, 0, data))
                    continue
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, np.asarray(starts, np.int64), 1)
                np.add.at(depth, np.asarray(stops, np.int64), -1)
                gone = np.cumsum(depth[:-1]) > 0
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((doc, len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    done = joined.mapInPandas(cut, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    if numbered:
        done = done.join(keyed.select("_doc", "_id"), F.col("doc") == F.col("_doc")).withColumn("doc", F.col("_id"))
    return done.select(F.col("doc").alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept")
