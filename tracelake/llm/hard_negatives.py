"""Hard negatives: candidates in Hilbert order as Parquet blocks with zone maps, of which anchors read what their windows need.

Vectors become whole numbers (``floor(scale * x)``) and are written in the order of (label, Hilbert key) as blocks of at most
``BLOCK`` rows of one label, a row of the table for each, with the least and the greatest value of every dimension. For an
anchor a, interval arithmetic over a block gives bounds of all its inner products: for each dimension the end of the interval
that makes a times x greatest, or least. So a search first joins tiles of anchors with pages of zone maps, which names the
blocks to read, and then reads these blocks alone:

* positives: blocks of the anchor's label whose upper bound reaches the score of its k-th best in its own block;
* negatives: blocks of other labels whose bounds meet the window between ``low`` percent of a positive's score and that score.

Bounds leave out no row of a result; how much they save depends on how the vectors cluster. Anchors, a stated query set, meet
all zone maps, in groups of bounded size on both sides; a hot label, or copies of one vector, are many blocks. Partial results
are the first few of each group.

The Hilbert curve runs over the ``AXES`` dimensions of greatest variance, between three deviations around their means, from
sums over all rows. Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
vectors shorter than the longest count as ending in zeros; repeated ids are separate rows, and ties go to the smaller id, then
to the earlier row in the order of blocks; windows of negative scores are empty; an empty table gives no rows. Scores beyond
64 bits raise an error. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

BLOCK, TILE = 256, 128
#: Blocks of a page of zone maps, and tiles of anchors that a task compares with it.
PAGE, TILES = 64, 8
AXES, BITS = 10, 6


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows of whole numbers below 2 ** bits), as 64-bit numbers.

    From the top bit down, each axis undoes the turn of the subcube that holds the point; Gray coding then joins the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(n):
            upper = (x[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            out = out << 1 | axis >> level & 1
    return out


def _matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of doubles, the shorter ones ending in zeros; nulls are NaN."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), max(size, default=0) if dims is None else dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _whole(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are finite, and those as whole numbers."""
    fine = np.isfinite(x).all(1)
    return fine, np.floor(scale * x[fine])


def _product(a: np.ndarray, b: np.ndarray, greatest: float) -> np.ndarray:
    """a @ b.T, exact: doubles hold it where no sum can pass 2 ** 53, else 64-bit integers do."""
    if greatest * greatest * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, greatest: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a and each box: the least and the greatest inner product with any point of the box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return _product(up, lo, greatest) + _product(down, hi, greatest), _product(up, hi, greatest) + _product(down, lo, greatest)


def _first(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties in ``order``."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((order[at], -score[at]))][:k]


class _Layout:
    """Means and deviations of the axes, the number of dimensions and the greatest value, from all rows."""

    def __init__(self, rows: DataFrame, vector: str, scale: int):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, q = _whole(_matrix(b.column(0)), scale)
                if len(q) and q.shape[1]:
                    columns = [pa.array(range(q.shape[1]), pa.int32()), *[pa.array(v, pa.float64()) for v in (np.full(q.shape[1], len(q)), q.sum(0), (q * q).sum(0), np.abs(q).max(0))]]
                    yield pa.record_batch(columns, names=["dim", "n", "s", "ss", "top"])

        parts = rows.select(vector).mapInArrow(sums, "dim int, n double, s double, ss double, top double")
        found = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.max("top").alias("top")).orderBy("dim").collect()
        self.dims, self.scale = max(1, len(found)), scale
        n = max((r["n"] for r in found), default=1.0)
        mean = np.array([r["s"] / n for r in found])
        deviation = np.sqrt(np.maximum([r["ss"] / n for r in found] - mean * mean if len(found) else [], 0))
        self.axes = np.argsort(-deviation, kind="stable")[:AXES]
        self.low, self.width = (mean - 3 * deviation)[self.axes], np.maximum(6 * deviation[self.axes], 1e-9)
        self.greatest = max((r["top"] for r in found), default=0.0) + 1
        if self.greatest**2 * self.dims >= 2.0**63:
            raise ValueError("inner products of these vectors pass 64 bits")
        self.kind = np.min_scalar_type(-int(self.greatest))  # the narrowest whole numbers that hold every component

    def keys(self, q: np.ndarray) -> np.ndarray:
        if not len(self.axes):
            return np.zeros(len(q), np.int64)
        level = np.floor((q[:, self.axes] - self.low) / self.width * (1 << BITS))
        return hilbert(np.clip(level, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _rows(buffers: list[bytes], layout: _Layout) -> np.ndarray:
    return np.frombuffer(b"".join(buffers), layout.kind).reshape(-1, layout.dims)


#: A block, or a tile of anchors (with the k-th best score in each one's own block).
_BLOCKS = "is_tile boolean, grp bigint, label bigint, first bigint, rows binary, ids binary, vectors binary, lo binary, hi binary, least binary"


def write_blocks(rows: DataFrame, layout: _Layout, is_anchor: Column, positives: int) -> DataFrame:
    """The table of blocks and tiles, from rows (_id, _label, _vector)."""
    greatest, dims, scale = layout.greatest, layout.dims, layout.scale

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine, q = _whole(_matrix(b.column("_vector"), dims), scale)
            kept = [b.column(c).filter(pa.array(fine)) for c in ("_id", "_label", "_anchor")]
            yield pa.record_batch([*kept, pa.array(layout.keys(q), pa.int64()), pa.array([r.tobytes() for r in q.astype(layout.kind)], pa.binary())], names=["id", "label", "anchor", "key", "q"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n_blocks, n_tiles, row = TaskContext.get().partitionId(), 0, 0, 0
        held: list[pa.RecordBatch] = []  # rows of one label that aren't written yet
        waiting: list[tuple] = []  # anchors of that label

        def emit(is_tile, grp, label, first, rows, ids, q, least):
            lo, hi = q.min(0).astype(layout.kind), q.max(0).astype(layout.kind)
            values = [is_tile, grp, label, first, rows.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(), q.tobytes(), lo.tobytes(), hi.tobytes(), least.astype(np.int64).tobytes()]
            types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        def tile():
            nonlocal n_tiles
            label, *parts = waiting[0][0], *[np.array([w[i] for w in waiting]) for i in (1, 2, 4)]
            q = np.stack([w[3] for w in waiting])
            waiting.clear()
            n_tiles += 1
            return emit(True, task << 24 | (n_tiles - 1) // TILES, label, n_tiles - 1, parts[0], parts[1], q, parts[2])

        def cut(last: bool):
            """Blocks of what is held: all of it at the end of a label, else whole ones."""
            nonlocal n_blocks, row
            if not held:
                return
            t = pa.Table.from_batches(held)
            held.clear()
            label = t.column("label")[0].as_py()
            end = len(t) if last else len(t) // BLOCK * BLOCK
            for i in range(0, end, BLOCK):
                part = t.slice(i, min(BLOCK, end - i))
                q, ids, anchors = _rows(part.column("q").to_pylist(), layout), part.column("id").to_numpy(), part.column("anchor").to_numpy()
                numbers = (task << 40) + row + np.arange(len(part))
                for a in np.flatnonzero(anchors):
                    others = np.delete(_product(q[a : a + 1], q, greatest)[0], a)
                    least = np.partition(others, len(others) - positives)[len(others) - positives] if len(others) >= positives else np.iinfo(np.int64).min
                    waiting.append((label, numbers[a], ids[a], q[a], least))
                    if len(waiting) == TILE:
                        yield tile()
                yield emit(False, task << 24 | n_blocks // PAGE, label, n_blocks, numbers, ids, q, np.zeros(0))
                n_blocks, row = n_blocks + 1, row + len(part)
            if end < len(t):
                held.extend(t.slice(end).to_batches())
            if last and waiting:
                yield tile()

        for b in batches:
            labels = b.column("label").to_numpy()
            ends = [*(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
            at = 0
            for end in ends:
                if end > at:
                    if held and held[0].column("label")[0].as_py() != labels[at]:
                        yield from cut(True)
                    held.append(b.slice(at, end - at))
                    at = end
                    if sum(len(x) for x in held) >= 16 * BLOCK:
                        yield from cut(False)
        yield from cut(True)

    keys = rows.withColumn("_anchor", is_anchor).select("_id", "_label", "_anchor", "_vector").mapInArrow(keyed, "id bigint, label bigint, anchor boolean, key bigint, q binary")
    order = ["label", "key", "id", "q"]
    # Numbers of rows, blocks and tiles are taken from this table, so they stay.
    return stage_table(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, _BLOCKS), "hard-blocks")


def _spread(tiles: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of tiles meet all groups of pages: both get keys (_t, _p) of meetings of bounded size."""
    n_tiles, n_pages = tiles.select("grp").distinct().count(), pages.select("grp").distinct().count()
    t, p = max(1, n_tiles // 4), max(1, n_pages // 16)
    salt = lambda n: F.pmod(F.xxhash64("grp"), F.lit(n)).cast("int")
    left = tiles.withColumn("_t", salt(t)).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    return left, pages.withColumn("_p", salt(p)).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(t - 1))))


#: Given a tile's row, its vectors and the least and greatest products with blocks: which blocks which anchors need.
Needs = Callable[[dict, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def choose(tiles: DataFrame, blocks: DataFrame, needs: Needs, layout: _Layout) -> DataFrame:
    """tile_grp, grp, first: the blocks that some anchor of a group of tiles must read, from zone maps alone."""
    greatest = layout.greatest
    left, right = _spread(tiles, blocks.select("grp", "label", "first", "lo", "hi"))

    def run(ts: pa.Table, ps: pa.Table) -> pa.Table:
        found: set[tuple[int, int, int]] = set()
        if len(ts) and len(ps):
            lo, hi = (_rows(ps.column(c).to_pylist(), layout) for c in ("lo", "hi"))
            labels, at = ps.column("label").to_numpy(), list(zip(ps.column("grp").to_pylist(), ps.column("first").to_pylist()))
            for t in ts.to_pylist():
                least, most = bounds(_rows([t["vectors"]], layout), lo, hi, greatest)
                found.update((t["grp"], *at[i]) for i in np.flatnonzero(needs(t, labels, least, most).any(0)))
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*sorted(found)) if found else ([], [], []))], names=["tile_grp", "grp", "first"])

    return left.groupBy("_t", "_p").cogroup(right.groupBy("_t", "_p")).applyInArrow(run, "tile_grp bigint, grp bigint, first bigint")


def read(tiles: DataFrame, blocks: DataFrame, chosen: DataFrame, needs: Needs, best: Callable, schema: str, layout: _Layout) -> DataFrame:
    """What best(tile, needed, scores, rows, ids) gives for each tile over the chosen blocks, a group of blocks at a time."""
    greatest = layout.greatest
    chosen = stage_table(chosen, "hard-chosen")
    left = tiles.withColumnRenamed("grp", "tile_grp").join(chosen.select("tile_grp", "grp").distinct(), "tile_grp")
    right = blocks.join(chosen, ["grp", "first"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(ts: pa.Table, bs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(ts) and len(bs):
            lo, hi, q = (_rows(bs.column(c).to_pylist(), layout) for c in ("lo", "hi", "vectors"))
            ids, rows = (np.frombuffer(b"".join(bs.column(c).to_pylist()), np.int64) for c in ("ids", "rows"))
            of = np.repeat(np.arange(len(bs)), [len(x) // 8 for x in bs.column("ids").to_pylist()])
            labels = bs.column("label").to_numpy()
            for t in ts.to_pylist():
                a = _rows([t["vectors"]], layout)
                needed = needs(t, labels, *bounds(a, lo, hi, greatest))
                own = np.flatnonzero(needed.any(0)[of])
                if len(own):
                    out += best(t, needed[:, of[own]], _product(a, q[own], greatest), rows[own], ids[own])
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[] for _ in names])], names=names)

    return left.groupBy("tile_grp", "grp").cogroup(right.groupBy("tile_grp", "grp")).applyInArrow(run, schema)


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Every anchor's first ``positives`` rows of its label, and for each the first ``negatives`` rows of other labels whose score
    is between ``low`` percent of the positive's score and that score.
    """
    usable = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    plain = rows.where(usable).select(F.col(vec_id).cast("bigint").alias("_id"), F.col(label).cast("bigint").alias("_label"), F.col(vector).cast("array<double>").alias("_vector"), F.coalesce(is_anchor, F.lit(False)).alias("_asked"))
    layout = _Layout(plain, "_vector", scale)
    table = write_blocks(plain, layout, F.col("_asked"), positives)
    tiles, blocks = (part.toDF(*part.columns) for part in (table.where("is_tile").drop("is_tile", "lo", "hi"), table.where("NOT is_tile").drop("is_tile", "least")))

    def same(t: dict, labels: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return (labels == t["label"]) & (most >= np.frombuffer(t["least"], np.int64)[:, None])

    def nearest(t: dict, needed: np.ndarray, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> list[tuple]:
        out, order = [], np.lexsort((rows, ids)).argsort()
        for i, (row, me) in enumerate(zip(np.frombuffer(t["rows"], np.int64), np.frombuffer(t["ids"], np.int64))):
            at = np.flatnonzero(needed[i] & (rows != row))
            at = at[_first(scores[i, at], order[at], positives)]
            out += [(t["grp_"], t["first"], i, int(row), int(me), int(ids[k]), int(rows[k]), int(scores[i, k])) for k in at]
        return out

    tiles = tiles.withColumn("grp_", F.col("grp"))
    schema = "grp bigint, first bigint, place bigint, anchor_row bigint, anchor_id bigint, positive_id bigint, positive_row bigint, positive_score bigint"
    near = read(tiles, blocks, choose(tiles, blocks, same, layout), same, nearest, schema, layout)
    rank = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row"))
    near = stage_table(near.withColumn("_k", rank).where(F.col("_k") <= positives).drop("_k"), "hard-positives")
    # A window of negative scores is empty: low percent of such a score is above it.
    windows = near.where("positive_score >= 0").groupBy("grp", "first").agg(F.collect_list(F.struct("place", "positive_id", "positive_row", "positive_score")).alias("windows"))
    asked = tiles.join(windows, ["grp", "first"])

    def ends(score):
        return -(-score * low // 100), score

    def other(t: dict, labels: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(most.shape, bool)
        for w in t["windows"]:
            a, z = ends(w["positive_score"])
            out[w["place"]] |= (most[w["place"]] >= a) & (least[w["place"]] <= z)
        return out & (labels != t["label"])

    def hardest(t: dict, needed: np.ndarray, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> list[tuple]:
        out, order = [], np.lexsort((rows, ids)).argsort()
        row, me = np.frombuffer(t["rows"], np.int64), np.frombuffer(t["ids"], np.int64)
        for w in t["windows"]:
            i, (a, z) = w["place"], ends(w["positive_score"])
            at = np.flatnonzero(needed[i] & (scores[i] >= a) & (scores[i] <= z))
            at = at[_first(scores[i, at], order[at], negatives)]
            out += [(int(row[i]), int(me[i]), w["positive_row"], w["positive_id"], w["positive_score"], int(ids[k]), int(rows[k]), int(scores[i, k])) for k in at]
        return out

    schema = "anchor_row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_row bigint, negative_score bigint"
    hard = read(asked, blocks, choose(asked, blocks, other, layout), other, hardest, schema, layout)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
