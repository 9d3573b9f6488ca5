import pytest

from tracelake.functions import values as V
from tracelake.operators import filters, intervals, listing
from tracelake.operators.filters import Filter, InvalidFilter


def test_fingerprint_ignores_spelling():
    assert Filter(types=("b", "a", "a")).fingerprint() == Filter(types=("a", "b")).fingerprint()
    assert Filter(types=("a",)).fingerprint() != Filter(types=("b",)).fingerprint()


def test_invalid_filters():
    for f in (Filter(min_confidence=101), Filter(from_us=5, to_us=5), Filter(path_prefix="\0")):
        with pytest.raises(InvalidFilter):
            filters.conditions(f)


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("size", [1, 3, 20])
def test_pages_give_every_row_once(spark, desc, size):
    cols = "id bigint, type string, artifact_id string, source_path string, ts bigint, deleted boolean, recovered boolean, confidence bigint, ingest_id string, summary string"
    recs = spark.createDataFrame([(i, "t", "a", "p", None if i % 3 == 0 else i // 4, False, False, None, "r", "s") for i in range(10)], cols)
    whole = [r["id"] for r in listing.ordered(recs, desc).collect()]
    f, seen = Filter(), []
    rows = listing.page(recs, size, desc).collect()
    while rows:
        seen += [r["id"] for r in rows]
        rows = listing.resume(recs, f, listing.cursor(f, rows[-1]["ts"], rows[-1]["id"], desc), size).collect()
    assert seen == whole


def test_runs(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 10, 12)], "k int, start bigint, stop bigint")
    merged = intervals.merge_runs(df, "k")
    assert sorted((r["start"], r["stop"]) for r in merged.collect()) == [(0, 7), (10, 12)]
    assert [(r["start"], r["stop"]) for r in intervals.complement(merged, "k").collect()] == [(7, 10)]


def test_range_join_against_all_pairs(spark):
    import random

    rnd = random.Random(8)
    size = lambda: rnd.choice([1, 3, 200, 5_000, 400_000, 1 << 40])
    ranges = [(i % 2, i, a := rnd.randrange(1 << 20), a + size()) for i in range(60)]
    extents = [(i % 2, rnd.randrange(1 << 20), size(), i * 1000) for i in range(60)]
    got = intervals.translate(spark.createDataFrame(ranges, "k int, id int, start bigint, stop bigint"), spark.createDataFrame(extents, "k int, at bigint, size bigint, target bigint"), "k", 64)
    want = [(i, t + max(a, p) - p, min(b, p + n) - max(a, p)) for k, i, a, b in ranges for j, p, n, t in extents if j == k and max(a, p) < min(b, p + n)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_range_join_sends_no_side_to_the_driver(spark):
    """Small estimates must not make a broadcast of the cells, and no side is laid on levels that the other doesn't have."""
    n = 2_000
    rows = spark.range(n)  # estimated at 8 bytes a row, as if nothing were multiplied
    got = intervals.translate(rows.selectExpr("id % 10 AS k", "id", "id * 7 AS start", "id * 7 + 100 AS stop"), rows.selectExpr("id % 10 AS k", "id * 7 AS at", "50L AS size", "id * 1000 AS target"), "k", 4096)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    assert {(r["id"], r["target_start"], r["length"]) for r in got.collect()} == {(i, j * 1000 + max(i - j, 0) * 7, min(i * 7 + 100, j * 7 + 50) - max(i, j) * 7) for i in range(n) for j in range(max(0, i - 20), min(n, i + 20)) if i % 10 == j % 10 and max(i, j) * 7 < min(i * 7 + 100, j * 7 + 50)}

    def laid(plan):
        """Rows that exchanges by key sent, adaptive plans and stages opened."""
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan" or name.endswith("QueryStage"):
            return laid(plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan())
        mine = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" and "_cell" in plan.toString().split("\n")[0] else 0
        return mine + sum(laid(plan.children().apply(i)) for i in range(plan.children().size()))

    assert 0 < laid(got._jdf.queryExecution().executedPlan()) < 4 * n


def test_times(spark):
    df = spark.createDataFrame([(0,), (-1,), (86_400_000,), (4_102_444_800_000,)], "v bigint")
    assert [r[0] for r in df.select(V.unix_us(df["v"], "ms")).collect()] == [None, None, 86_400_000_000, None]
