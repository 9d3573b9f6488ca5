"""Audited append after a stop at every step; localised faults; chains over streams."""

from itertools import islice

import pytest
from pyspark.sql import functions as F

from tracelake.operators import localise
from tracelake.sources import append
from tracelake.streaming import chain


def rows(spark, n, of):
    return spark.range(n).select(F.concat(F.lit(of), "id").alias("name"), (F.col("id") * 7 % 13).alias("k")).repartition(3)


def test_a_stop_after_any_step(spark, tmp_path):
    path, first = str(tmp_path), 1
    for n, step in enumerate(append.STEPS):
        name, recs = f"in{n}", rows(spark, 25 + n, step)
        done = list(islice(append.append_steps(spark, path, name, recs, ["k", "name"], 10), n + 1))
        assert done[-1] == step
        left = [tuple(r) for r in append.interrupted(spark, path).collect()]
        if step != "commit":
            assert left == [(name, step)]
            if n:
                assert append.visible(spark, path).where(F.col("ingest") == name).count() == 0
            with pytest.raises(append.Unfinished):
                append.append(spark, path, "another", recs, ["k", "name"])
        append.append(spark, path, name, recs, ["k", "name"], 10)
        append.append(spark, path, name, recs, ["k", "name"], 10)  # once more changes nothing
        got = append.visible(spark, path).where(F.col("ingest") == name).orderBy("id").collect()
        assert [r["id"] for r in got] == list(range(first, first + 25 + n)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
        assert [r["batch"] for r in got] == [(r["id"] - first) // 10 for r in got]
        first += 25 + n
        assert append.interrupted(spark, path).count() == 0
    assert append.chain_faults(append.log(spark, path)).count() == 0 and append.log(spark, path).count() == 10
    assert append.batch_faults(spark, path).count() == 0
    edited = append.log(spark, path).withColumn("n", F.when(F.col("seq") == 4, 99).otherwise(F.col("n"))).where("seq <> 7")
    assert sorted(tuple(r) for r in append.chain_faults(edited).collect()) == [(4, "hash"), (8, "gap")]
    at = f"{path}/records/in1"
    changed = spark.read.parquet(at).withColumn("name", F.when(F.col("id") == 40, "x").otherwise(F.col("name"))).where("batch < 2").collect()
    spark.createDataFrame(changed, spark.read.parquet(at).schema).write.mode("overwrite").parquet(at)
    assert sorted(tuple(r) for r in append.batch_faults(spark, path).collect()) == [("in1", 1, "differs"), ("in1", 2, "missing")]


def test_abandoned_ids_are_given_again(spark, tmp_path):
    path = str(tmp_path)
    list(islice(append.append_steps(spark, path, "a", rows(spark, 9, "a"), ["name"]), 3))
    append.abandon(spark, path, "a")
    append.append(spark, path, "b", rows(spark, 4, "b"), ["name"])
    append.append(spark, path, "none", rows(spark, 0, "c"), ["name"])
    assert sorted(r["id"] for r in append.visible(spark, path).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        append.abandon(spark, path, "b")
    with pytest.raises(ValueError):
        append.append(spark, path, "a", rows(spark, 9, "a"), ["name"])


@pytest.mark.parametrize("n", [1, 64])
def test_faults_are_found_in_few_rows(spark, n):
    base = spark.range(200_000).select("id", F.xxhash64("id").alias("v"))
    wrong = [i * 3_001 + 17 for i in range(n)]
    other = base.where(~F.col("id").isin(wrong[::3])).withColumn("v", F.when(F.col("id").isin(wrong[1::3]), F.lit(0)).otherwise(F.col("v"))).union(spark.createDataFrame([(300_000 + i, 1) for i in wrong[2::3]], "id long, v long"))
    sides, trace = [(s, localise.sums(s, "id", ["v"])) for s in (other, base)], []
    got = {(r["id"], r["state"]) for r in localise.differing(*sides[0], *sides[1], "id", ["v"], trace).collect()}
    assert got == {(i, "missing") for i in wrong[::3]} | {(i, "differs") for i in wrong[1::3]} | {(300_000 + i, "extra") for i in wrong[2::3]}
    assert [b for b, _ in trace] == [20, 16, 12, 8, 4, 0] and trace[-1][1] <= 32 * n and sum(k for _, k in trace) <= 2 * (16 * 5 * n + 20)
    assert localise.differing(*sides[0], *sides[0], "id", ["v"]).count() == 0


def test_a_chain_goes_on_after_a_restart(spark, tmp_path):
    a = chain.said_hash(append.FIRST, 1, "x")
    b = chain.said_hash(a, 2, "y")
    c = chain.said_hash(b, 3, "z")
    parts = [[("k", 1, "x", append.FIRST, a), ("j", 2, "x", append.FIRST, a)], [("k", 3, "z", b, c), ("k", 2, "y", a, b)], [("k", 3, "z", b, c), ("k", 4, "w", "0", "0")]]
    schema = "chain string, seq bigint, said string, prev string, hash string"
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        chain.watch(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("j", 2, "gap"), ("k", 3, "repeated"), ("k", 4, "prev")]
