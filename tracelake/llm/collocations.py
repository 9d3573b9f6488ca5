"""Phrases whose words keep together, from an FM-index over the word ids of each shard.

Every task indexes what it reads, a shard at a time and each language apart: words become ids, pieces and documents end in a
separator, and the positions are put in the order of the next ``DEPTH`` words. The index is the Burrows-Wheeler transform in
that order, from which ``psi`` follows: the row of the position one word on (the inverse of the LF mapping).

The occurrences of a phrase are an interval of rows. A phrase of m + 1 words is extended in both directions at once: its rows
are part of the interval of its first m words (right extension), and ``psi`` leads them into that of its last m words (left
extension). So intervals of m + 1 words begin where those of one word do, or where ``psi`` enters another interval of m words:
one gather for each level and no sorting. Only phrases whose first and last m words are frequent over all shards are extended;
that leaves out no frequent phrase. Counts are summed across shards after each level; a phrase is known by the pair of its two
shorter phrases, so sums are exact. The phrases of a level are dealt into waves by a hash of these pairs, and summed one wave
after the other, so that the disk holds the counts of one wave at a time.

A phrase of 2 to ``DEPTH`` words with at least ``least`` occurrences is a candidate. It is scored at its weakest cut:
floor(2,000,000 a / (l + r)) for a occurrences of its own, l and r of its two parts. Candidates nearly all of whose occurrences
lie in a longer candidate are dropped: the longer one by a single word decides, as the counts between are no smaller.

Defined cases: null texts are empty, a null language is ``und``; repeated rows count each time; empty tables give no rows;
words may hold any characters and be of any length; phrases don't cross pieces or documents. A shard has about ``shard_words``
words and ends at a separator, so the longest piece bounds it from below. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mix64
from .common import drop_tables, free_shuffles, small_batches, stage_table

DEPTH = 4
#: A-Z to a-z, tabs to spaces, and what ends a piece to a byte that UTF-8 doesn't have.
_END = b"\xff"
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)
_SLICE = 1 << 21


def slices(text: bytes, size: int = _SLICE) -> Iterator[bytes]:
    """text in lower case, in parts that end a piece, each of about that size."""
    text, at = text.translate(_BYTES) + _END, 0
    while at < len(text):
        end = text.find(_END, at + size) + 1 or len(text)
        yield text[at:end]
        at = end


class Shard:
    """Word ids of the texts of one language; 0 ends a piece."""

    def __init__(self):
        self.ids: dict[bytes, int] = {_END: 0}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.size = 0

    def add(self, text: bytes) -> None:
        """One or more slices."""
        found = pa.array(text.replace(_END, b" \xff ").split(), pa.binary()).dictionary_encode()
        ids = np.array([self.ids.setdefault(w, len(self.ids)) for w in found.dictionary.to_pylist()], np.int32)
        if len(ids):
            self.parts.append(ids[found.indices.to_numpy()])
            self.size += len(found)

    def sequence(self) -> np.ndarray:
        s = np.concatenate(self.parts)
        return s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]


def transform(s: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of s, taken as a ring, in the order of the next DEPTH symbols."""
    key = s.astype(np.int64) * (int(s.max()) + 1)
    key += np.roll(s, -1)
    # Pairs by rank, so that pairs of pairs fit too: a shard has fewer than 2 ** 31 positions.
    values, key = np.unique(key, return_inverse=True)
    key *= len(values)
    key += np.roll(key // len(values), -2)
    return np.roll(s, 1)[np.argsort(key)]


class Index:
    """Intervals of phrases over a transform."""

    def __init__(self, bwt: np.ndarray):
        self.counts = np.bincount(bwt)
        self.first = np.cumsum(self.counts) - self.counts  # where the rows of each word begin
        self.psi = np.argsort(bwt, kind="stable").astype(np.int32)
        self.edges = np.zeros(len(bwt), bool)
        self.edges[self.first[self.counts > 0]] = True
        self.words = self.edges

    def deeper(self) -> None:
        """From intervals of m words to those of m + 1."""
        of = (np.cumsum(self.edges, dtype=np.int32) - 1)[self.psi]
        self.edges = self.words.copy()
        self.edges[1:] |= of[1:] != of[:-1]

    def spread(self, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Each row's value, of the interval that begins at a start; -1 for the others."""
        at = np.flatnonzero(self.edges)
        out = np.full(len(at), -1, np.int64)
        out[np.searchsorted(at, starts)] = values
        return np.repeat(out, np.diff(np.append(at, len(self.edges))))

    def extend(self, starts: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of phrases one word longer than the named ones: start, count, name of the first words and name of the last words."""
        name = self.spread(starts, names)
        self.deeper()
        at = np.flatnonzero(self.edges)
        count = np.diff(np.append(at, len(self.edges)))
        left, right = name[at], name[self.psi[at]]
        both = (left >= 0) & (right >= 0)
        return at[both], count[both], left[both], right[both]


def _packed(bwt: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed; and how many they are."""
    data = bwt.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def index_shards(docs: DataFrame, text: str = "text", lang: str = "lang", shard_words: int = 2_000_000) -> DataFrame:
    """shard, lang, n (words), words, starts, counts (of each word), bwt: an FM-index for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, {}

        def flush(of: str) -> pa.RecordBatch:
            nonlocal made
            shard = held.pop(of)
            bwt = transform(shard.sequence())
            counts = np.bincount(bwt, minlength=len(shard.ids))
            starts = np.cumsum(counts) - counts
            made += 1
            columns = [[(task << 12) + made], [of], [int(counts[1:].sum())], [list(shard.ids)[1:]], [starts[1:]], [counts[1:]], [_packed(bwt)]]
            types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "lang", "n", "words", "starts", "counts", "bwt"])

        def add(of: str, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
            held.setdefault(of, Shard()).add(b"".join(parts))
            if sum(s.size for s in held.values()) >= shard_words:
                yield flush(max(held, key=lambda k: held[k].size))

        for b in batches:
            waiting: dict[str, list[bytes]] = {}
            for of, t in zip(b.column(0).to_pylist(), b.column(1)):
                for part in slices(t.as_py() or b""):
                    waiting.setdefault(of, []).append(part)
                    if sum(map(len, waiting[of])) >= _SLICE:
                        yield from add(of, waiting.pop(of))
            for of, parts in waiting.items():
                yield from add(of, parts)
        for of in list(held):
            yield flush(of)

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "shard bigint, lang string, n bigint, words array<binary>, starts array<bigint>, counts array<bigint>, bwt binary")


def _frequent(rows: DataFrame, key: list[str], least: int, name: str) -> DataFrame:
    """Staged: the places (at) of phrases with at least so many occurrences over all shards, and the phrase's name; its key and f where it has its name from.

    A phrase is named by the least of its places: no other has that place on its level.
    """
    over = Window.partitionBy(*key)
    found = rows.withColumns({"f": F.sum("c").over(over), "name": F.min("at").over(over)}).where(F.col("f") >= least)
    return stage_table(found.select("at", "name", *[F.when(F.col("at") == F.col("name"), F.col(c)).alias(c) for c in (*key, "f")]), name)


def _extension(depth: int, wave: int = 0, waves: int = 1):
    """What a shard gives for a wave of a level: the phrases of so many words, from its index and the frequent ones that are a word shorter."""

    def run(index: pa.Table, known: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64),) * 4
        if len(index) and len(known):
            fm = Index(_unpacked(index.column("bwt")[0].as_py()))
            for _ in range(depth - 2):
                fm.deeper()
            start, count, left, right = fm.extend(known.column("at").to_numpy() & 0xFFFFFFFF, known.column("name").to_numpy())
            mine = mix64(mix64(left.astype(np.uint64)) + right.astype(np.uint64)) % np.uint64(waves) == np.uint64(wave)
            out = (start[mine] + (index.column("shard")[0].as_py() << 32), count[mine], left[mine], right[mine])
        return pa.table([pa.array(x.astype(np.int64)) for x in out], names=["at", "c", "k1", "k2"])

    return run


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, inside_pct: int = 80, shard_words: int = 2_000_000, waves: int = 2) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    small_batches(docs.sparkSession)
    shards = stage_table(index_shards(docs, text, lang, shard_words), "fm-shards")
    place = F.shiftleft("shard", 32)
    words = shards.select(place.alias("_base"), "lang", F.explode(F.arrays_zip("words", "starts", "counts")).alias("w")).select((F.col("_base") + F.col("w.starts")).alias("at"), F.col("w.counts").alias("c"), "lang", F.col("w.words").alias("word"))
    level = _frequent(words, ["lang", "word"], least, "fm-words")
    own = level.where("at = name")
    kept = stage_table(own.select("name", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), F.array("f").alias("pre"), F.array("f").alias("suf")), "fm-phrases")
    levels = [kept]
    for depth in range(2, DEPTH + 1):
        known = level.select(F.shiftright("at", 32).alias("shard"), "at", "name")
        both = shards.select("shard", "bwt").groupBy("shard").cogroup(known.groupBy("shard"))
        found = []
        for wave in range(waves):
            # Spark may have held the last wave's shuffles until its listeners had heard of the end of that query.
            free_shuffles(docs.sparkSession)
            pairs = both.applyInArrow(_extension(depth, wave, waves), "at bigint, c bigint, k1 bigint, k2 bigint")
            found.append(_frequent(pairs, ["k1", "k2"], least, f"fm-level{depth}"))
        last, level = level, reduce(DataFrame.union, found)
        drop_tables(last)
        phrases = level.where("at = name").select("name", "k1", "k2", "f")
        one = levels[-1].select(F.col("name").alias("k1"), "lang", "phrase", "pre")
        two = levels[-1].select(F.col("name").alias("k2"), "last", "suf")
        phrases = phrases.join(one, "k1").join(two, "k2").select("name", "k1", "k2", "f", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"))
        levels.append(stage_table(phrases, "fm-phrases"))
    return _ranked(levels, shards.groupBy("lang").agg(F.sum("n").alias("n")), top, inside_pct)


def _ranked(levels: list[DataFrame], totals: DataFrame, top: int, inside_pct: int) -> DataFrame:
    found = None
    for size, (phrases, longer) in enumerate(zip(levels[1:], [*levels[2:], None]), 2):
        cuts = []
        for k in range(1, size):
            left, right = F.col("pre")[k - 1], F.col("suf")[size - k - 1]
            score = F.expr(f"CAST(f AS DECIMAL(20, 0)) * 2000000BD DIV (pre[{k - 1}] + suf[{size - k - 1}])")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
        scored = phrases.withColumn("cut", F.array_min(F.array(*cuts)))
        if longer is not None:
            around = longer.select(F.explode(F.array("k1", "k2")).alias("name"), F.col("f").alias("_f")).groupBy("name").agg(F.max("_f").alias("_f"))
            scored = scored.join(around, "name", "left").where(F.col("_f").isNull() | (F.col("_f") * 100 < F.col("f") * inside_pct))
        scored = scored.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("bigint").alias("score"))
        found = scored if found is None else found.unionByName(scored)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The first of each of many parts of a language, then the first of those.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    found = found.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
