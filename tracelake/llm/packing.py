"""Packing token pieces into sequences of a fixed capacity: dominance reduction, then best fit.

Documents become token ids with an end id behind each; longer ones are cut into pieces (``encode``). What fits together
depends on lengths alone, and there are no more lengths than the capacity, so ``plan`` works on the count of pieces of each
length: at most ``capacity`` numbers, however many documents there are.

* Reduction (Martello and Toth): a set F that holds a piece w *dominates* if every feasible set with w can be matched, member
  by member or by groups, to members of F that are at least as long; then some best packing has F as a sequence. Sets of one
  to three pieces are tried for each length, longest first, and fixed in all their copies at once; what is left is smaller,
  and is tried again until nothing is fixed.
* Best fit: what remains goes, longest first, where it leaves the least room. Equal sequences are handled as one.

``place`` numbers the pieces of each length and gives each number its sequence and offset. Numbers come from counts of each
(input partition, length), so a length that a third of all pieces has is many small groups. The driver holds the counts and
the plan: runs of equal slots, whose number depends on the capacity alone.

Defined cases: null text is empty, and an empty text is the end id alone; repeated rows and ids are separate documents; an
empty table gives no rows; other columns pass through, but for those named like a result; no text is cut short.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks
from .common import free_name, small_batches, stage_table

CAPACITY = 2048
ENCODED = ("piece", "start", "length", "ids")
RESULTS = (*ENCODED, "sequence_id", "offset")

#: Runs of white space beyond this are left to ``tokenizers``: the quicker library's patterns recur for each character.
_LONG_BLANKS = re.compile(r"\s{500}")


class Encoder:
    """Ids of a tokenizer file, special tokens being ordinary text.

    A byte-level BPE whose merges are in the order of its ids is the same as its ranks; ``tiktoken`` then gives the same ids
    in a third of the time. Any other file, and texts with very long blanks, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.quick = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
            return None
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))) or sorted(vocab.values()) != list(range(256 + len(pairs))):
            return None
        # Byte-level files write bytes as printable characters: those that are printable as themselves, the rest from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.quick is not None and not _LONG_BLANKS.search(text):
            return np.array(self.quick.encode_ordinary(text), np.uint32)
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs without their text, a row for each piece: ``piece``, ``start``, ``length``, ``ids`` (little-endian 32-bit numbers).

    A document of more than ``capacity`` ids is cut into pieces of that length; the first takes what is over, so it may be
    shorter. tokenizer: path of a tokenizer file that every machine has.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text and c not in ENCODED]
    value = free_name("_text", docs)
    schema = docs.select(*keep).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Encoder(tokenizer)
        for b in batches:
            kept = pa.Table.from_batches([b]).select(keep)
            for first, texts in chunks(b.column(len(keep)).to_pylist()):
                row, piece, start, length, ids = [], [], [], [], []
                for i, t in enumerate(texts, first):
                    all_ids = np.append(ids_of(t), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range((len(all_ids) - 1) % capacity + 1, len(all_ids), capacity), len(all_ids)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i), piece.append(k), start.append(a), length.append(z - a), ids.append(all_ids[a:z].tobytes())
                out = kept.take(pa.array(row, pa.int64())) if keep else None
                columns = [*(out.combine_chunks().columns if keep else ()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield from pa.table(columns, names=[*keep, *ENCODED]).to_batches()

    return docs.select(*keep, F.col(text).alias(value)).mapInArrow(run, schema)


class _Counts:
    """How many pieces of each length are left; finds the next shorter or longer length that has any."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: n for w, n in counts.items() if n}
        self.lengths = sorted(self.n)

    def take(self, w: int, n: int) -> None:
        self.n[w] -= n
        if not self.n[w]:
            del self.n[w]
            del self.lengths[bisect.bisect_left(self.lengths, w)]

    def has(self, w: int, used: list[int]) -> bool:
        return self.n.get(w, 0) > used.count(w)

    def longest(self, limit: int, used: list[int]) -> int | None:
        """The longest length up to limit of which there is one besides those used."""
        i = bisect.bisect_right(self.lengths, limit) - 1
        while i >= 0 and not self.has(self.lengths[i], used):
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def shortest(self, least: int, used: list[int]) -> int | None:
        """The shortest length of at least that, besides those used."""
        i = bisect.bisect_left(self.lengths, least)
        while i < len(self.lengths) and not self.has(self.lengths[i], used):
            i += 1
        return self.lengths[i] if i < len(self.lengths) else None

    def best_pair(self, room: int, used: list[int]) -> int:
        """The most that two more pieces can fill of room; 0 if no two fit."""
        most = 0
        for x in reversed(self.lengths[: bisect.bisect_right(self.lengths, room)]):
            if 2 * x <= most:
                break
            if self.has(x, used) and (y := self.longest(min(room - x, x), [*used, x])):
                most = max(most, x + y)
        return most


def _dominating(left: _Counts, w: int, capacity: int) -> list[int] | None:
    """A set with w that dominates every feasible set with w, or None if none of one to three pieces is proven to."""
    room = capacity - w
    k = left.longest(room, [w])
    if k is None:
        return [w]  # nothing fits beside it
    if k == room:
        return [w, k]  # the others of any set with w fill no more than k does
    s1 = left.shortest(1, [w])
    s2 = left.shortest(1, [w, s1])
    if s2 is None or s1 + s2 > room:
        return [w, k]  # no set with w has three pieces
    s3 = left.shortest(1, [w, s1, s2])
    if s3 is not None and s1 + s2 + s3 <= room:
        return None  # sets of four and more: no short proof
    if k >= left.best_pair(room, [w]):
        return [w, k]
    b = left.longest(room - k, [w, k])
    if b is None:
        return None
    # Another triple could be better only with both pieces longer than b, the longer of them no longer than k.
    x = left.shortest(b + 1, [w, k])
    y = left.shortest(b + 1, [w, k, x]) if x is not None else None
    return [w, k, b] if x is None or y is None or x + y > room else None


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that are fixed, with the number of their copies, and the counts of what is left."""
    left, fixed, again = _Counts(counts), [], True
    while again:
        again = False
        for w in list(reversed(left.lengths)):
            while left.n.get(w):
                found = _dominating(left, w, capacity)
                if found is None:
                    break
                copies = min(left.n[x] // found.count(x) for x in found)
                for x in set(found):
                    left.take(x, copies * found.count(x))
                fixed.append((tuple(found), copies))
                again = True
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling lengths: sequences as sets of pieces, with the number of their copies."""
    full: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by the room that is left
    rooms: list[int] = []

    def put(pieces: tuple[int, ...], n: int, room: int) -> None:
        if room == 0:
            full.append((pieces, n))
        elif room in open_:
            open_[room].append((pieces, n))
        else:
            open_[room] = [(pieces, n)]
            bisect.insort(rooms, room)

    for w in sorted(counts, reverse=True):
        m = counts[w]
        while m:
            i = bisect.bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pieces, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, pieces, n = capacity, (), m
            # The least room that fits stays the least while more pieces of this length fit into it.
            q = room // w
            whole = min(n, m // q)
            if whole:
                put(pieces + (w,) * q, whole, room - q * w)
                m -= whole * q
            rest = m if whole < n else 0
            if rest:
                put(pieces + (w,) * rest, 1, room - rest * w)
                m = 0
            unused = n - whole - bool(rest)
            if unused and pieces:
                put(pieces, unused, room)
    return full + [x for room in rooms for x in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for so many pieces of each length: (lengths, copies)."""
    if any(not 0 < w <= capacity for w in counts):
        raise ValueError(f"pieces have 1 to {capacity} tokens")
    fixed, left = reduce_counts(counts, capacity)
    return fixed + best_fit(left, capacity)


def _runs(sequences: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of equal slots in the order of (length, number of the piece): length, first number, pieces in each sequence, first sequence, offset."""
    rows, base, given = [], 0, {}
    for pieces, copies in sequences:
        at = 0
        for w in dict.fromkeys(pieces):  # equal pieces lie side by side
            q = pieces.count(w)
            rows.append((w, given.get(w, 0), q, base, at))
            given[w] = given.get(w, 0) + q * copies
            at += q * w
        base += copies
    rows.sort()
    return dict(zip(("length", "first", "each", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def place(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``: sequences of at most capacity, without gaps."""
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    at, part, number, slot = (free_name(c, pieces) for c in ("_at", "_part", "_number", "_slot"))
    staged = stage_table(pieces.select(*keep).withColumn(at, F.monotonically_increasing_id()), "pack-pieces")
    staged = staged.withColumn(part, F.shiftright(at, 33))  # the partition that wrote it
    counts = stage_table(staged.groupBy(F.col(length).cast("long").alias("_of"), F.col(part).alias("_in")).agg(F.count("*").alias("_n")), "pack-counts")
    runs = _runs(plan({r[0]: r[1] for r in counts.groupBy("_of").agg(F.sum("_n")).collect()}, capacity))
    own = {w: np.flatnonzero(runs["length"] == w) for w in np.unique(runs["length"]).tolist()}

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def slots(of: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        w, k, out = of.to_numpy(np.int64), numbers.to_numpy(np.int64), np.zeros((2, len(of)), np.int64)
        for x in np.unique(w).tolist():
            here = np.flatnonzero(w == x)
            run = own[x][np.searchsorted(runs["first"][own[x]], k[here], "right") - 1]
            inside = k[here] - runs["first"][run]
            out[0, here] = runs["sequence"][run] + inside // runs["each"][run]
            out[1, here] = runs["offset"][run] + inside % runs["each"][run] * x
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    earlier = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_of", "_in", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    joined = staged.join(firsts, (staged[length] == firsts["_of"]) & (staged[part] == firsts["_in"]))
    joined = joined.withColumn(number, F.col("_from") + F.row_number().over(Window.partitionBy("_of", "_in").orderBy(at)) - 1)
    return joined.withColumn(slot, slots("_of", number)).select(*keep, f"{slot}.sequence_id", f"{slot}.offset")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """encode and place: pieces with their ids, ``sequence_id`` and ``offset``."""
    return place(encode(docs, tokenizer, text, capacity, end_id), capacity=capacity)
