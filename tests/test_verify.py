import json
import random

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracelake.functions import payloads
from tracelake.functions import values as V
from tracelake.operators import chains, integrity, supersede, verify
from tracelake.sources import records as R


def test_walk_states(spark):
    rows = [(1, None, None), (2, 1, "h1"), (3, 2, "h2"), (4, 3, "bad"), (5, 99, "h99"), (6, 7, "h7"), (7, 6, "h6"), (8, 6, "h6"), (9, 9, "h9"), (10, 4, "h4")]
    nodes = spark.createDataFrame([(k, p, c, f"h{k}") for k, p, c in rows], "k long, p long, claimed string, digest string")
    got = {r["k"]: (r["last"], r["depth"], r["state"]) for r in chains.walk(nodes, "k", "p", 1, "claimed", "digest").collect()}
    assert got == {1: (1, 0, "ok"), 2: (1, 1, "ok"), 3: (1, 2, "depth"), 4: (4, 0, "differs"), 5: (5, 0, "missing"), 6: (None, None, "cycle"), 7: (None, None, "cycle"), 8: (None, None, "cycle"), 9: (None, None, "cycle"), 10: (4, 1, "differs")}
    assert chains.walk(nodes.limit(0), "k", "p").count() == 0


def test_long_ways_against_brute_force(spark):
    rnd = random.Random(3)
    up = {k: rnd.randrange(k) if k and rnd.random() < 0.98 else None for k in range(300)}
    nodes = spark.createDataFrame([(k, p, k * 7 % 101) for k, p in up.items()], "k long, p long, v long")
    depth, least = {}, {}
    for k, p in up.items():
        depth[k] = 0 if p is None else depth[p] + 1
        least[k] = k * 7 % 101 if p is None else min(k * 7 % 101, least[p])
    assert {r["k"]: r["depth"] for r in chains.walk(nodes, "k", "p", 1000).collect()} == depth
    assert {r["k"]: r["least"] for r in chains.chain_minimum(nodes, "k", "p", "v").collect()} == least


def test_a_minimum_reaches_down_a_chain_of_a_thousand(spark):
    nodes = spark.createDataFrame([(k, k - 1 if k else None, 5 if k else 1) for k in range(1000)] + [(2000, 2001, 9), (2001, 2002, 3), (2002, 2000, 7), (2003, 2000, 8), (2004, 9999, 4)], "k long, p long, v long")
    got = {r["k"]: r["least"] for r in chains.chain_minimum(nodes, "k", "p", "v").collect()}
    assert {v for k, v in got.items() if k < 1000} == {1} and [got[k] for k in range(2000, 2005)] == [3, 3, 3, 3, 4]


def test_differences_count_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (3,), (None,)], "x int")
    assert sorted((r["x"], r["side"]) for r in integrity.differences(a, b).collect()) == [(1, "stored"), (1, "stored"), (2, "stored"), (3, "recomputed"), (3, "recomputed")]


def test_schema_differences():
    f = lambda n, t, null=True: StructField(n, t, null)
    have = StructType([f("a", LongType()), f("b", LongType()), f("x", StringType()), f("n", LongType())])
    want = StructType([f("a", LongType()), f("b", StringType()), f("c", StringType()), f("n", LongType(), False)])
    assert verify.schema_differences(have, want) == [("b", "type"), ("c", "missing"), ("n", "nullable"), ("x", "extra")]


def test_allocation_against_bytes(spark):
    rnd = random.Random(9)
    runs, asked, want = [], [], {}
    for k in range(4):
        cuts = sorted(rnd.sample(range(200), 12))
        runs += [(k, a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)] if k != 3 else []
        free = {x for kk, a, b in runs if kk == k for x in range(a, b)}
        cuts = sorted(rnd.sample(range(220), 8))
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        asked += [(k, a, b) for a, b in spans]
        inside = sum(x in free for a, b in spans for x in range(a, b))
        total = sum(b - a for a, b in spans)
        want[k] = (0, 0, total) if k == 3 else (inside, total - inside, 0)
    cols = "k int, start bigint, stop bigint"
    got = verify.allocation(spark.createDataFrame(asked, cols), spark.createDataFrame(runs, cols), "k").collect()
    assert {r["k"]: (r["free"], r["allocated"], r["unknown"]) for r in got} == want


def test_superseded_by_is_the_next_complete_run(spark):
    got = {(r["ingest_id"], r["artifact_id"]): r["by"] for r in supersede.superseded_by(spark.createDataFrame([(i, "x") for i in ("r0", "r1", "r2", "r4")], "ingest_id string, artifact_id string")).collect()}
    assert got == {("r0", "x"): "r1", ("r2", "x"): "r4"} and R.RUNS


def test_canonical_json():
    c = payloads.canonical_json
    assert c('{"b":1.50,"a":{"z":[ 1e5 , "\\u00e9\\u0001\\/" ]}}') == '{"a":{"z":[1e5,"é\\u0001/"]},"b":1.50}'
    assert c('{"a":1,"a":2}') is None and c("[1]") is None and c("{") is None and c(None) is None and c('{"a":NaN}') is None and c('{"a":' * 70 + "1" + "}" * 70) is None
    assert json.loads(c('{"é":true,"z":null,"aa":false}')) == {"aa": False, "z": None, "é": True}


def test_texts_paths_and_times(spark):
    df = spark.createDataFrame([("/a/./b//c",), ("a",), ("/a/../b",), ("\\x\\y",)], "p string")
    assert [r[0] for r in df.select(payloads.logical_path(F.col("p"))).collect()] == ["/a/b/c", None, None, "/x/y"]
    df = spark.createDataFrame([("a<b>.txt. ",), ("con.txt",), ("",), ("ok",)], "p string")
    assert [r[0] for r in df.select(payloads.local_name(F.col("p"))).collect()] == ["a_b_.txt_", "_con.txt", "_", "ok"]
    df = spark.createDataFrame([("a\x1b[0m‮z",)], "t string")
    assert df.select(payloads.printable(F.col("t"))).first()[0] == "a<U+001B>[0m<U+202E>z"
    df = spark.createDataFrame([(0,), (-1,), ((1 << 63) - 1,), (-(1 << 63),), (1 << 62,), (86_400,)], "v bigint")
    assert [r[0] for r in df.select(V.time_class(F.col("v"), V.unix_us(F.col("v"), "s"))).collect()] == ["sentinel"] * 4 + ["invalid", "valid"]
