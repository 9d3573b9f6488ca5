"""Hard negatives against plain loops; bounds, the curve and what is read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import hard_negatives as hn


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (5, 1)])
def test_curve_visits_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hn.hilbert(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_point():
    rng = np.random.default_rng(3)
    for _ in range(30):
        box, a = rng.integers(-300, 300, (40, 6)), rng.integers(-300, 300, (5, 6))
        least, most = hn.bounds(a, box.min(0)[None], box.max(0)[None], 301)
        scores = a @ box.T
        assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    assert hn._product(np.full((1, 4), 1 << 27), np.full((1, 4), (1 << 27) + 1), 2.0**27 + 2)[0, 0] == 4 * (1 << 27) * ((1 << 27) + 1)


def plain(rows, anchors):
    fine = [(i, l, [math.floor(256 * float(x)) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, l, v) in enumerate(fine):
        if anchors(i):
            near = sorted((-dot(v, w), j) for m, (j, k, w) in enumerate(fine) if m != n and k == l)[:5]
            far = sorted((-dot(v, w), j) for j, k, w in fine if k != l)
            for s, j in near:
                window = [(t, k) for t, k in far if 80 * -s <= 100 * -t <= 100 * -s][:5]
                out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(window, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def clustered(seed, n, dims=6, groups=12):
    """Clusters of two labels each, with exact copies and ties."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, dims))
    rows = []
    for i in range(n):
        v = middle[i % groups] + rng.normal(0, 0.05, dims) if i % 5 else middle[0]
        rows.append((i, [float(np.float32(x)) for x in v], int(i % groups // 2 if i % 3 else i % 4)))
    return rows


def test_against_plain_loops(spark):
    rows = clustered(1, 900)
    odd = [(None, [1.0] * 6, 1), (900, None, 1), (1000, [1.0] * 6, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (1200, [float("nan")] * 6, 2), (1300, [float("inf")] * 6, 2), (1400, [0.5, 0.5], 3), (1500, [], 3), (1600, [0.0] * 6, 77)]
    got = rows_of(hn.mine(spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "'mine' AS grp", "'mine' AS _id").repartition(5), F.col("vec_id") % 100 == 0))
    want = plain([(i, v if v is None else v + [0.0] * (6 - len(v)), l) for i, v, l in rows + odd], lambda i: i % 100 == 0)
    assert got == want and len({a for a, *_ in got}) >= 8


def test_repeated_rows_are_separate(spark):
    rows = clustered(2, 60) * 2
    got = rows_of(hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == plain(rows, lambda i: i % 20 == 0)


def test_empty_and_lonely(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)], SCHEMA)
    assert hn.mine(one, F.lit(True)).count() == 0
    empty = [(i, [], i % 2) for i in range(6)]
    assert rows_of(hn.mine(spark.createDataFrame(empty, SCHEMA), F.col("vec_id") == 0)) == plain(empty, lambda i: i == 0) != []
    with pytest.raises(ValueError):
        hn.mine(spark.createDataFrame([(0, [1e30, 1.0], 1)], SCHEMA), F.lit(True))


def test_blocks_are_left_out_where_vectors_cluster(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (40, 8))
    rows = [(i, [float(x) for x in middle[i % 40] + rng.normal(0, 0.02, 8)], int(i % 40 % 4)) for i in range(24_000)]
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("_id"), F.col("label").cast("bigint").alias("_label"), F.col("embedding").cast("array<double>").alias("_vector"))
    layout = hn._Layout(df, "_vector", 256)
    table = hn.write_blocks(df, layout, F.col("_id") % 1000 == 0, 5)
    tiles, blocks = table.where("is_tile").toDF(*table.columns), table.where("NOT is_tile")
    assert blocks.agg(F.sum(F.length("ids") / 8)).first()[0] == 24_000
    need = hn.choose(tiles, blocks, lambda t, labels, least, most: (labels == t["label"]) & (most >= np.frombuffer(t["least"], np.int64)[:, None]), layout)
    asked = tiles.select("grp").distinct().count()
    assert need.count() < 0.5 * asked * blocks.count()
