"""N-gram Jaccard join by a token-group matrix; every link between different texts is found.

* Texts with equal shingle sets form a class, of which the smallest id stands for all.
* A class shows a prefix of its shingles in one fixed order: n - ceil(t n) + k of them, so that two linked classes share
  k (four, or fewer in tiny sets) of their prefixes' shingles at least. Frequent shingles come last in that order, which
  keeps the lists of documents with a shingle short; any order is right.
* Similar classes are put into groups of about ``GROUP``: those of like size that share a shingle with the same smallest
  document.
* The token-group matrix has each group's union of prefix shingles. Where two groups share too few shingles of their
  unions, or their sizes don't fit, no member of one can link to a member of the other. Only groups that qualify are
  opened: their members' whole sets meet once for each pair of groups, and links come from one matrix product.
* First each group is opened with itself and with one representative, the smallest group that has some of its shingles. Groups
  whose members all lie in one component by then act as one, with the union of their shingles: a further link
  inside would join nothing. Only pairs of such units that qualify are looked at group by group, and opened. So a family of F
  near copies opens about F / ``GROUP`` pairs, not their square, and doesn't list the others either.
* Components are taken over all links.

Bitmaps of fixed size thin what the tasks send; exact joins follow. Defined cases: texts without words, and null texts,
have no shingles and link with nothing; with fewer words than a shingle has, the whole sequence is the only one; rows of
the same id, or of none, are apart; a component is named by its smallest id, null if none of its rows has one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mix64, random64
from .common import row_keys, scratch, small_batches, stage_table
from .components import connected_components

CHUNK, SHARED, HEAVY, MAX_HEAVY, BITMAP_BITS, GROUP, COLUMNS, SLOTS = 300_000, 4, 20, 500_000, 20, 128, 8_192, 256
_POSITIONS, _LETTERS, _PLACES = random64(64, 21), random64(256, 22), random64(16, 23)


def _lowered() -> np.ndarray:
    out = np.arange(256)
    out[65:91] += 32
    return _LETTERS[out]


_LOWER = _lowered()
_SPACE = np.array([i in (32, 9, 10, 11, 12, 13) for i in range(256)])


def shingle_sets(data: list[bytes | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    first, held, n = 0, [], 0
    for i, b in enumerate([*data, None]):
        b = bytes(b) if b is not None else b""
        if held and (n + len(b) > CHUNK or i == len(data)):
            yield from ((first + k, x) for k, x in enumerate(_sets(held, size)))
            first, held, n = i, [], 0
        held.append(b)
        n += len(b)


def _sets(data: list[bytes], size: int) -> Iterator[np.ndarray]:
    joined = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(b) + 1 for b in data])))
    inside = ~_SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    none = np.zeros(0, np.uint64)
    if not len(starts):
        for _ in data:
            yield none
        return
    since = np.arange(len(joined)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(joined)]))))
    value = np.where(inside, _LOWER[joined] * _POSITIONS[since & 63] + (since >> 6).astype(np.uint64), np.uint64(0))
    words = mix64(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _PLACES[15])
    bounds = np.searchsorted(starts, at)
    m = len(words) - size + 1
    grams = mix64(sum(words[k : k + m] * _PLACES[k] for k in range(size))) if m > 0 else none
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            yield np.unique(grams[lo : hi - size + 1])
        elif hi > lo:
            yield mix64(np.add.reduce(words[lo:hi] * _PLACES[: hi - lo], keepdims=True) + np.uint64(hi - lo))
        else:
            yield none


def prefix_length(n: int, pct: int) -> int:
    least = -(-pct * n // 100)
    return n - least + min(SHARED, least)


def _shared(n: Column, pct: int) -> Column:
    return F.least(F.lit(SHARED), F.ceil(n * pct / 100)).cast("int")


def prefix(tokens: np.ndarray, heavy: np.ndarray, pct: int) -> np.ndarray:
    """The first shingles of a set, those in heavy (upper 32 bits, sorted) last."""
    p = prefix_length(len(tokens), pct)
    if not len(heavy) or not len(tokens):
        return tokens[:p]
    top = (tokens >> np.uint64(32)).astype(np.uint32)
    is_heavy = heavy[np.minimum(np.searchsorted(heavy, top), len(heavy) - 1)] == top
    return np.concatenate((tokens[~is_heavy], tokens[is_heavy]))[:p]


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has every value of the one column (64 bits, well mixed)."""
    h = hashes.columns[0]
    words = hashes.groupBy(F.shiftrightunsigned(h, 64 - BITMAP_BITS).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, {58 - BITMAP_BITS}) & 63 AS int))")).alias("b")).toPandas()
    out = np.zeros(1 << BITMAP_BITS, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] >> ((h >> np.uint64(58 - BITMAP_BITS)) & np.uint64(63))) & np.uint64(1) == 1


def id_hash(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))


class Sets:
    """The shingle sets of documents (_doc, _data)."""

    def __init__(self, docs: DataFrame, size: int, pct: int):
        self.docs, self.size, self.pct = docs, size, pct

    def signatures(self) -> DataFrame:
        """doc, n, sig: the size and a signature of each row's set."""
        size = self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [(len(x), int(np.add.reduce(mix64(x ^ np.uint64(0xA5A5A5A5)))) if len(x) else 0) for _, x in shingle_sets(list(b["_data"]), size)]
                yield pd.DataFrame({"doc": b["_doc"].to_numpy(), "n": [f[0] for f in found], "sig": np.array([f[1] for f in found], np.uint64).view(np.int64)})

        return self.docs.mapInPandas(run, "doc bigint, n bigint, sig bigint")

    def prefixes(self, only: np.ndarray, heavy: np.ndarray, short: bool = False, tokens: np.ndarray | None = None) -> DataFrame:
        """token, doc, n of the prefixes of documents in the bitmap only, as far as in the bitmap tokens; short: the upper halves of tokens alone."""
        size, pct = self.size, self.pct

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b[in_bitmap(only, id_hash(b["_doc"].to_numpy()))]
                ids = b["_doc"].to_numpy()
                parts, rows, sizes, held = [], [], [], 0
                for i, x in shingle_sets(list(b["_data"]), size):
                    p = prefix(x, heavy, pct)
                    if tokens is not None:
                        p = p[in_bitmap(tokens, p)]
                    parts.append(p)
                    rows.append(np.full(len(p), ids[i]))
                    sizes.append(np.full(len(p), len(x), np.int32))
                    held += len(p)
                    if held > 200_000:
                        yield frame(parts, rows, sizes)
                        parts, rows, sizes, held = [], [], [], 0
                if parts:
                    yield frame(parts, rows, sizes)

        def frame(parts: list, rows: list, sizes: list) -> pd.DataFrame:
            t = np.concatenate(parts)
            if short:
                return pd.DataFrame({"token": (t >> np.uint64(32)).astype(np.uint32).view(np.int32)})
            return pd.DataFrame({"token": t.view(np.int64), "doc": np.concatenate(rows), "n": np.concatenate(sizes)})

        return self.docs.mapInPandas(run, "token int" if short else "token bigint, doc bigint, n int")

    def whole(self, only: np.ndarray) -> DataFrame:
        """doc, tokens (binary) of documents in the bitmap."""
        size = self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b[in_bitmap(only, id_hash(b["_doc"].to_numpy()))]
                ids = b["_doc"].to_numpy()
                out = [(ids[i], x.tobytes()) for i, x in shingle_sets(list(b["_data"]), size)]
                yield pd.DataFrame(out, columns=["doc", "tokens"])

        return self.docs.mapInPandas(run, "doc bigint, tokens binary")


def _hashed(ids: DataFrame) -> DataFrame:
    """The id_hash of a table's one column of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": id_hash(b.iloc[:, 0].to_numpy()).view(np.int64)})

    return ids.mapInPandas(run, "h bigint")


def forest(sets: list[np.ndarray], left: int, pct: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of similar sets: between the first left ones and the rest, or among all if left is 0."""
    n = np.array([len(x) for x in sets], np.int64)
    if len(sets) == 2:
        small, large = sorted(sets, key=len)
        shared = np.array([[0, int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())], [0, 0]])
    else:
        tokens, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, slot = np.repeat(np.arange(len(sets)), n), np.cumsum(times > 1) - 1
        met = times[at] > 1
        row, slot = row[met], slot[at[met]]
        shared = np.zeros((len(sets), len(sets)), np.int64)
        for lo in range(0, int(slot.max(initial=-1)) + 1, COLUMNS):  # shingles of one set alone are left out
            m = (slot >= lo) & (slot < lo + COLUMNS)
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[row[m], slot[m] - lo] = 1
            shared += np.rint(has @ has.T).astype(np.int64)
    ok = np.triu((100 * shared >= pct * (n[:, None] + n[None, :] - shared)) & (shared > 0), 1)
    if left:
        ok[:left, :left] = False
        ok[left:] = False
    up = list(range(len(sets)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        if (x := root(i)) != (y := root(j)):
            up[x] = y
            out.append((i, j))
    return out


def verified(shipped: DataFrame, pct: int) -> DataFrame:
    """a, b: links inside each pair of groups, of rows (g1, g2, g, doc, tokens) that lie together and in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        key = None

        def links() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            left = 0 if key[0] == key[1] else sum(g == key[0] for g, _, _ in held)
            if left == len(held) or (key[0] != key[1] and not left):
                return []
            held.sort(key=lambda r: (r[0] != key[0], r[1]))
            found = forest([np.frombuffer(t, np.uint64) for _, _, t in held], left, pct)
            return [(held[i][1], held[j][1]) for i, j in found]

        for b in batches:
            out: list[tuple[int, int]] = []
            for g1, g2, g, doc, tokens in zip(b["g1"], b["g2"], b["g"], b["doc"], b["tokens"], strict=True):
                if (g1, g2) != key:
                    out += links()
                    held.clear()
                    key = (g1, g2)
                held.append((g, doc, tokens))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(links(), columns=["a", "b"], dtype=np.int64)

    return shipped.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInPandas(run, "a bigint, b bigint")


def linked(sets: Sets, classes: DataFrame) -> DataFrame:
    """node, label: components of the classes' documents (doc), for those with a link."""
    pct = sets.pct
    only = bitmap_of(_hashed(classes.where("n > 0").select("doc")))
    heavy = np.zeros(0, np.uint32)
    counted = sets.prefixes(only, heavy, short=True).groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > HEAVY)
    heavy = np.sort(counted.orderBy(F.desc("k"), "token").limit(MAX_HEAVY).select("token").toPandas()["token"].to_numpy(np.int32).view(np.uint32))
    met = sets.prefixes(only, heavy).groupBy("token").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo != hi").select("token", "lo")
    met = stage_table(met, "jaccard-tokens")
    lists = sets.prefixes(only, heavy, tokens=bitmap_of(met.select("token"))).join(met, "token")
    lists = stage_table(lists.join(classes.select("doc"), "doc", "left_semi"), "jaccard-lists")
    # Groups of about GROUP similar documents: by the smallest id that a document shares a shingle with and its size (to a
    # factor of the similarity), dealt by hash.
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    near = lists.groupBy("doc", "n").agg(F.min("lo").alias("f")).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / pct)))).withColumn("s", slot)
    near = stage_table(near, "jaccard-near")
    # Counted by slot, so that the members of a large family meet their family's count in many tasks.
    slots = near.groupBy("f", "band", "s").agg(F.count("*").alias("k"))
    parts = slots.groupBy("f", "band").agg(F.ceil(F.sum("k") / GROUP).alias("parts"))
    slots = slots.join(parts, ["f", "band"]).select("f", "band", "s", "parts")
    members = stage_table(near.join(slots, ["f", "band", "s"]).select("doc", "n", F.xxhash64("f", "band", F.pmod(F.xxhash64("doc"), F.col("parts"))).alias("g")), "jaccard-members")
    # The matrix: the groups by the shingles in their unions, and the range of their members' sizes there.
    matrix = lists.join(members.select("doc", "g"), "doc").groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("k"))
    matrix = stage_table(matrix, "jaccard-matrix")

    def fits(one: str, two: str) -> Column:
        """Whether sizes of two sides, in least and most with these endings, can link."""
        return (F.col(f"most{one}") * 100 >= F.col(f"least{two}") * pct) & (F.col(f"most{two}") * 100 >= F.col(f"least{one}") * pct)

    def enough(rows: DataFrame, keys: list[str], least: Column) -> DataFrame:
        """The keys that share shingles enough to hold a link; a row is a shared shingle."""
        return rows.groupBy(*keys).agg(F.count("*").alias("_k"), F.min(least).alias("_least")).where(F.col("_k") >= _shared(F.col("_least"), pct)).drop("_least")

    def links(pairs: DataFrame) -> DataFrame:
        sides = pairs.select("g1", "g2", F.explode(F.array_distinct(F.array("g1", "g2"))).alias("g"))
        wanted = sides.select("g").distinct().join(members, "g").select("doc").distinct()
        held = sets.whole(bitmap_of(_hashed(wanted))).join(members.select("doc", "g"), "doc")
        return stage_table(verified(sides.join(held, "g").select("g1", "g2", "g", "doc", "tokens"), pct), "jaccard-links")

    smaller = F.least("least1", "least2")
    lead = matrix.groupBy("token").agg(F.min("g").alias("g1"), F.min_by("least", "g").alias("least1"), F.min_by("most", "g").alias("most1"))
    two = matrix.select("token", *[F.col(c).alias(f"{c}2") for c in ("g", "least", "most")])
    led = enough(two.join(lead, "token").where((F.col("g1") < F.col("g2")) & fits("1", "2")), ["g1", "g2"], smaller)
    own = enough(matrix.where("k > 1"), ["g"], F.col("least")).select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    first = stage_table(own.union(led.groupBy("g2").agg(F.max_by("g1", "_k").alias("g1")).select("g1", "g2")), "jaccard-first")
    found = links(first)
    # What each group's members are in so far: a unit of groups of one component, or a group of several.
    named = members.join(connected_components(found, "jaccard-so-far"), F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("label", "doc"))
    units = named.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).select("g", F.when(F.col("lo") == F.col("hi"), F.xxhash64(F.lit("all"), "lo")).otherwise(F.xxhash64(F.lit("one"), "g")).alias("u"))
    placed = stage_table(matrix.join(units, "g").select("token", "g", "u", "least", "most"), "jaccard-units")
    unions = placed.groupBy("token", "u").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    one, two = (unions.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("u", "least", "most")]) for i in (1, 2))
    met = stage_table(enough(one.join(two, "token").where((F.col("u1") < F.col("u2")) & fits("1", "2")), ["u1", "u2"], smaller).drop("_k"), "jaccard-met")
    one, two = (placed.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("u", "g", "least", "most")]) for i in (1, 2))
    rest = enough(met.join(one, "u1").join(two, ["u2", "token"]).where(fits("1", "2")), ["g1", "g2"], smaller).select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"))
    rest = stage_table(rest.join(first, ["g1", "g2"], "left_anti"), "jaccard-rest")
    return connected_components(found.union(links(rest)), "jaccard-components")


def join_documents(docs: DataFrame, size: int = 5, pct: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: linked at a Jaccard similarity of pct / 100 of size-word shingles."""
    small_batches(docs.sparkSession)
    keyed, numbered = row_keys(docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")), "_id", "_text", "jaccard-rows")
    body = keyed.select("_doc", F.coalesce(F.col("_text").cast("binary"), F.lit(b"")).alias("_data"))
    sets = Sets(body, size, pct)
    signed = stage_table(sets.signatures(), "jaccard-signatures")
    classes = stage_table(signed.where("n > 0").groupBy("sig", "n").agg(F.min("doc").alias("doc")), "jaccard-classes")
    with scratch(docs.sparkSession):
        labels = stage_table(linked(sets, classes), "jaccard-labels", kept=True)
    named = classes.join(labels, classes["doc"] == labels["node"], "left").select("sig", "n", F.coalesce("label", "doc").alias("label"))
    out = signed.join(named, ["sig", "n"], "left")
    out = out.select("doc", F.col("n").alias("n_shingles"), F.coalesce("label", "doc").alias("component"))
    if not numbered:
        return out.select(F.col("doc").alias(doc_id), "n_shingles", F.col("component").alias("component_id"))
    out = out.join(keyed.select("_doc", "_id"), F.col("doc") == F.col("_doc"))
    # Named by the smallest id in it; null where none has an id.
    names = out.groupBy("component").agg(F.min("_id").alias("component_id"))
    return out.join(names, "component").select(F.col("_id").alias(doc_id), "n_shingles", "component_id")
