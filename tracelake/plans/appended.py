"""Registered queries of the audited append, of localised differences and of hash chains."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import localise
from tracelake.sources import append
from tracelake.sources.append import FIRST
from tracelake.sources.staging import new_path, staged
from tracelake.streaming import chain

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Ingests by order status, and after how many steps each is interrupted before it is completed.
INGESTS = {"F": 2, "O": 4, "P": 5}
ORDERS = "o_orderkey, o_custkey, o_orderpriority"


def appended(spark: SparkSession, d: str) -> str:
    """The folder of three ingests, two of them interrupted and completed later; one more was abandoned on the way."""
    path = new_path(spark, "append")
    rows = lambda status: spark.read.parquet(f"{d}/orders.parquet").where(F.col("o_orderstatus") == status).selectExpr(*ORDERS.split(", "))
    for n, (status, steps) in enumerate(INGESTS.items()):
        if n == 1:
            for _ in islice(append.append_steps(spark, path, "given-up", rows("F"), ["o_orderkey"]), 2):
                pass
            append.abandon(spark, path, "given-up")
        for _ in islice(append.append_steps(spark, path, status, rows(status), ["o_custkey", "o_orderkey"], 500), steps):
            pass
        append.append(spark, path, status, rows(status), ["o_custkey", "o_orderkey"], 500)
    return path


NUMBERED = "WITH x AS (SELECT o_orderstatus AS ingest, o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderstatus, o_custkey, o_orderkey) AS id FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')), f AS (SELECT ingest, min(id) AS first_id, count(*) AS n FROM x GROUP BY 1), "
Q["q_append_ids"] = lambda s, d: append.visible(s, appended(s, d)).select("ingest", "id", "o_orderkey", F.col("batch").cast("bigint").alias("batch"))
SQL["q_append_ids"] = NUMBERED.removesuffix(", ") + " SELECT ingest, id, o_orderkey, (id - first_id) // 500 AS batch FROM x JOIN f USING (ingest)"
Q["q_append_log"] = lambda s, d: append.log(s, appended(s, d)).select("seq", "kind", "ingest", "first_id", "n")
SQL["q_append_log"] = NUMBERED + "e AS (SELECT ingest, first_id, n, rank() OVER (ORDER BY ingest) AS k FROM f) SELECT row_number() OVER (ORDER BY o) AS seq, * EXCLUDE (o) FROM (SELECT 'start' AS kind, ingest, first_id, 0 AS n, k * 10 AS o FROM e UNION ALL SELECT 'end', ingest, first_id, n, k * 10 + 1 FROM e UNION ALL SELECT 'start', 'given-up', first_id, 0, 18 FROM e WHERE k = 2 UNION ALL SELECT 'abort', 'given-up', 0, 0, 19)"

# Differences of two sides of all lines, found by sums of ranges.
LINE = "l_orderkey * 8 + l_linenumber AS id, l_partkey, l_suppkey, l_quantity"
CHANGED = "CASE WHEN l_orderkey % 1009 = 7 THEN l_quantity + 1 ELSE l_quantity END"


def localised(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    columns = ["l_partkey", "l_suppkey", "l_quantity"]
    expected = lines.where("l_partkey % 211 <> 3").selectExpr(*LINE.split(", "))
    stored = lines.where("l_suppkey % 97 <> 5").withColumn("l_quantity", F.expr(CHANGED)).selectExpr(*LINE.split(", "))
    kept = [staged(localise.sums(side, "id", columns), "sums") for side in (stored, expected)]
    return localise.differing(stored, kept[0], expected, kept[1], "id", columns)


Q["q_localised"] = localised
SQL["q_localised"] = f"""WITH e AS (SELECT {LINE}, list((l_partkey, l_suppkey, l_quantity)) OVER w AS v FROM lineitem WHERE l_partkey % 211 <> 3 WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT {LINE}, list((l_partkey, l_suppkey, {CHANGED})) OVER w AS v FROM lineitem WHERE l_suppkey % 97 <> 5 WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT DISTINCT coalesce(e.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra' ELSE 'differs' END AS state FROM (SELECT DISTINCT id, v FROM e) e FULL JOIN (SELECT DISTINCT id, v FROM s) s ON e.id = s.id WHERE e.v IS DISTINCT FROM s.v"""

# Chains of events by user: some entries say something else than was hashed, some name another hash before them, some are gone.
SAID, OTHER_PREV, GONE = "event_id % 97 = 5", "event_id % 89 = 7", "event_id % 101 = 3"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """chain, seq, said, prev, hash of each event."""
    held = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    step = lambda a, x: F.struct((a["seq"] + 1).alias("seq"), F.sha2(F.concat_ws("|", a["hash"], (a["seq"] + 1).cast("string"), x["event_type"]), 256).alias("hash"), F.concat(a["out"], F.array(F.struct(x["event_id"].alias("event_id"), (a["seq"] + 1).alias("seq"), x["event_type"].alias("said"), a["hash"].alias("prev"), F.sha2(F.concat_ws("|", a["hash"], (a["seq"] + 1).cast("string"), x["event_type"]), 256).alias("hash")))).alias("out"))
    first = F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(FIRST).alias("hash"), F.array().cast("array<struct<event_id:bigint,seq:bigint,said:string,prev:string,hash:string>>").alias("out"))
    each = held.select("user_id", F.explode(F.aggregate("e", first, step)["out"]).alias("x")).select(F.col("user_id").cast("string").alias("chain"), "x.*")
    return each.where(f"NOT ({GONE})").withColumn("said", F.expr(f"CASE WHEN {SAID} THEN 'other' ELSE said END")).withColumn("prev", F.expr(f"CASE WHEN {OTHER_PREV} THEN 'other' ELSE prev END"))


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The faults, from three files that come one after the other and two runs of the stream."""
    path, rows = new_path(spark, "chain"), staged(entries(spark, d), "entries")
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    for n in range(3):
        part = F.when(F.col("seq") <= 5, 0).when(F.col("seq") <= 20, 1).otherwise(2)
        rows.where(part == n).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if n:
            chain.watch(spark, f"{path}/in", schema, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(chain.FAULTS).parquet(f"{path}/out")


Q["q_chain_stream"] = streamed
SQL["q_chain_stream"] = f"""WITH h AS (SELECT user_id, list(event_id ORDER BY event_id, event_type) AS ids, list(event_type ORDER BY event_id, event_type) AS said FROM events GROUP BY 1),
s AS (SELECT user_id, ids[i] AS event_id, i::BIGINT AS seq, said[i] AS said, list_reduce(list_prepend('{FIRST}', list_transform(range(1, i), lambda k: k || '|' || said[k])), lambda a, x: sha256(a || '|' || x)) AS prev FROM h, LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i)),
t AS (SELECT user_id, seq, CASE WHEN {SAID} THEN 'other' ELSE said END AS said, CASE WHEN {OTHER_PREV} THEN 'other' ELSE prev END AS prev, sha256(prev || '|' || seq || '|' || said) AS hash FROM s WHERE NOT ({GONE})),
w AS (SELECT *, coalesce(lag(seq) OVER o, 0) AS b, coalesce(lag(hash) OVER o, '{FIRST}') AS bh FROM t WINDOW o AS (PARTITION BY user_id ORDER BY seq))
SELECT * FROM (SELECT user_id::VARCHAR AS chain, seq, CASE WHEN seq <> b + 1 THEN 'gap' WHEN prev <> bh THEN 'prev' WHEN hash <> sha256(prev || '|' || seq || '|' || said) THEN 'hash' END AS fault FROM w) WHERE fault IS NOT NULL"""
