"""Registered queries of verification, provenance and the payload's shape, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import payloads
from tracelake.functions import values as V
from tracelake.operators import carve, chains, integrity, reconcile, stats, supersede, verify
from tracelake.plans.searched import RECORDS
from tracelake.sources import records as R

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def both(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name], SQL[name] = run, sql


def _split(columns: str) -> list[str]:
    """Columns of a list that has commas inside parentheses."""
    out, depth, part = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


# Provenance: parts derive from a third of their number; some are missing, some claim another digest, and 0 derives from itself.
NODES = "p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_partkey DIV 3 END AS parent, CASE WHEN p_partkey % 3 = 0 THEN concat('h', cast(p_partkey DIV 3 AS string), CASE WHEN p_partkey % 45 = 0 AND p_partkey > 0 THEN 'x' ELSE '' END) END AS claimed, concat('h', cast(p_partkey AS string)) AS digest"
WALK = f"""WITH RECURSIVE nodes AS (SELECT {NODES.replace('DIV', '//')} FROM part WHERE p_partkey = 0 OR p_partkey % 35 <> 0),
w AS (SELECT k, k AS pos, 0::BIGINT AS depth FROM nodes UNION ALL SELECT w.k, n.parent, w.depth + 1 FROM w JOIN nodes n ON n.k = w.pos JOIN nodes p ON p.k = n.parent AND p.digest = n.claimed WHERE w.depth < 70),
e AS (SELECT k, max(depth) AS depth, arg_max(pos, depth) AS pos FROM w GROUP BY k)
SELECT e.k, CASE WHEN depth < 70 THEN pos END AS last, CASE WHEN depth < 70 THEN depth END AS depth,
CASE WHEN depth = 70 THEN 'cycle' WHEN n.parent IS NULL THEN CASE WHEN depth > 4 THEN 'depth' ELSE 'ok' END WHEN n.parent NOT IN (SELECT k FROM nodes) THEN 'missing' ELSE 'differs' END AS state FROM e JOIN nodes n ON n.k = e.pos"""
both("q_chain_walk", lambda s, d: chains.walk(read(s, d, "part").where("p_partkey = 0 OR p_partkey % 35 <> 0").selectExpr(*_split(NODES)), "k", "parent", 4, "claimed", "digest"), WALK)


# Stored rows of runs and batches against what records give; every seventh run row is wrong.
both(
    "q_run_totals",
    lambda s, d: verify.compared(_runs(read(s, d, "orders")).selectExpr("run", "CASE WHEN run % 7 = 0 THEN batches + 1 ELSE batches END AS batches", "CASE WHEN run % 5 = 0 THEN records - 1 ELSE records END AS records", "first_id", "last_id").where("run % 11 <> 3"), _runs(read(s, d, "orders").where("o_custkey % 40 <> 9")), ["run"], ["batches", "records", "first_id", "last_id"]),
    """WITH b AS (SELECT o_custkey % 40 AS run, (o_orderkey - 1) // 500 AS batch_no, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT run, count(*) AS batches, sum(n)::BIGINT AS records FROM b GROUP BY 1), st AS (SELECT run FROM r WHERE run % 11 <> 3), re AS (SELECT run FROM r WHERE run <> 9)
SELECT run, CASE WHEN st.run IS NULL THEN 'not-stored' WHEN re.run IS NULL THEN 'not-found' WHEN run % 7 = 0 OR run % 5 = 0 THEN 'differs' ELSE 'equal' END AS state,
CASE WHEN st.run IS NOT NULL AND re.run IS NOT NULL THEN concat_ws(',', CASE WHEN run % 7 = 0 THEN 'batches' END, CASE WHEN run % 5 = 0 THEN 'records' END) ELSE '' END AS wrong FROM st FULL JOIN re USING (run)""",
)


def _runs(orders: DataFrame) -> DataFrame:
    recs = orders.selectExpr("o_orderkey AS id", "o_custkey % 40 AS run")
    return verify.run_totals(verify.batches_of(recs, "run", 500), "run")


TALLY = "SELECT user_id % 20 AS run, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"
both(
    "q_tallies",
    lambda s, d: verify.compared(verify.tallies(read(s, d, "events").selectExpr("user_id % 20 AS run", "event_type AS kind"), "run", "kind").selectExpr("run", "kind", "n + CAST(run = 3 AS bigint) AS n"), verify.tallies(read(s, d, "events").where("event_type <> 'error' OR user_id % 20 <> 5").selectExpr("user_id % 20 AS run", "event_type AS kind"), "run", "kind"), ["run", "kind"], ["n"]),
    f"WITH t AS ({TALLY}) SELECT run, kind, CASE WHEN run = 5 AND kind = 'error' THEN 'not-found' WHEN run = 3 THEN 'differs' ELSE 'equal' END AS state, CASE WHEN run = 3 THEN 'n' ELSE '' END AS wrong FROM t",
)
both(
    "q_next_ids",
    lambda s, d: verify.next_ids({"orders": (read(s, d, "orders"), "o_orderkey"), "part": (read(s, d, "part"), "p_partkey"), "none": (read(s, d, "part").where("p_partkey < 0"), "p_partkey")}),
    "SELECT 'orders' AS name, count(*) AS n, max(o_orderkey) + 1 AS next_id FROM orders UNION ALL SELECT 'part', count(*), max(p_partkey) + 1 FROM part UNION ALL SELECT 'none', 0, 1",
)
both(
    "q_batch_digests_checked",
    lambda s, d: verify.compared(_digests(s, d).withColumn("digest", F.when(F.col("batch_no") % 4 == 1, "0").otherwise(F.col("digest"))), _digests(s, d), ["batch_no"], ["n", "digest"]),
    RECORDS + ", b AS (SELECT DISTINCT (id - 1) // 500 AS batch_no FROM records WHERE type = 'account') SELECT batch_no, CASE WHEN batch_no % 4 = 1 THEN 'differs' ELSE 'equal' END AS state, CASE WHEN batch_no % 4 = 1 THEN 'digest' ELSE '' END AS wrong FROM b",
)


def _digests(s: SparkSession, d: str) -> DataFrame:
    return integrity.batch_digest(R.records(s, d).where("type = 'account'"), ["id", "type"], 500)


ARTIFACTS = "c_custkey AS artifact_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey > 0 THEN c_custkey DIV 2 END AS parent_id, c_custkey % 3 = 0 AS recovered, c_custkey % 50 + 50 AS confidence"
RECOVERED = "l_orderkey * 8 + l_linenumber AS id, l_partkey AS artifact_id, l_linenumber % 2 = 0 AS recovered, CASE WHEN l_linenumber <> 4 THEN l_suppkey % 90 END AS confidence"
both(
    "q_recovered_rules",
    lambda s, d: verify.recovered_rules(read(s, d, "lineitem").selectExpr(*_split(RECOVERED)), read(s, d, "customer").selectExpr(*_split(ARTIFACTS))),
    f"""WITH RECURSIVE a AS (SELECT {ARTIFACTS.replace('DIV', '//')} FROM customer), w AS (SELECT artifact_id AS k, artifact_id AS at, confidence AS v, parent_id AS up FROM a UNION ALL SELECT w.k, a.artifact_id, least(w.v, a.confidence), a.parent_id FROM w JOIN a ON a.artifact_id = w.up),
m AS (SELECT k, min(v) AS least FROM w GROUP BY k), r AS (SELECT {RECOVERED} FROM lineitem)
SELECT id, rule FROM (SELECT id, CASE WHEN a.artifact_id IS NULL THEN 'orphan' WHEN a.recovered AND NOT r.recovered THEN 'live-on-recovered' WHEN r.recovered AND r.confidence IS NULL THEN 'no-confidence' WHEN r.recovered AND r.confidence > least THEN 'above-chain' END AS rule
FROM r LEFT JOIN a ON a.artifact_id = r.artifact_id LEFT JOIN m ON m.k = r.artifact_id) WHERE rule IS NOT NULL""",
)
both(
    "q_rehash",
    lambda s, d: verify.rehashed(read(s, d, "pages").where("page_id % 9 <> 4").select("url", F.when(F.col("page_id") % 6 == 1, "0").otherwise(F.sha2("html", 256)).alias("sha256"), F.octet_length("html").cast("bigint").alias("size")), read(s, d, "pages").where("page_id % 8 <> 3"), "url", "html"),
    """WITH m AS (SELECT url, count(*) AS n, min(CASE WHEN page_id % 6 = 1 THEN '0' ELSE sha256(html) END) AS h, min(strlen(html)) AS z FROM pages WHERE page_id % 9 <> 4 GROUP BY 1), f AS (SELECT url, count(*) AS n, min(sha256(html)) AS h, min(strlen(html)) AS z FROM pages WHERE page_id % 8 <> 3 GROUP BY 1)
SELECT url, CASE WHEN m.n > 1 OR f.n > 1 THEN 'duplicate' WHEN f.n IS NULL THEN 'missing' WHEN m.n IS NULL THEN 'unmanifested' WHEN m.h = f.h AND m.z = f.z THEN 'bound' ELSE 'differs' END AS state FROM m FULL JOIN f USING (url)""",
)
both(
    "q_repeated_ages",
    lambda s, d: verify.repeated(read(s, d, "lineitem"), ["l_partkey"], "l_linenumber", (F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 5)),
    "SELECT l_partkey, count(DISTINCT l_linenumber) AS ages FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 2 AND count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber > 5) = 0",
)
both(
    "q_allocation",
    lambda s, d: verify.allocation(read(s, d, "orders").selectExpr("o_custkey % 20 AS k", "o_orderkey * 100 AS start", "o_orderkey * 100 + o_custkey % 90 + 1 AS stop"), read(s, d, "orders").where("o_custkey % 20 <> 7").selectExpr("o_custkey % 20 AS k", "o_orderkey * 100 + 30 AS start", "o_orderkey * 100 + 60 AS stop"), "k"),
    """WITH r AS (SELECT o_custkey % 20 AS k, o_custkey % 90 + 1 AS size, least(greatest(o_custkey % 90 + 1 - 30, 0), 30) AS inside FROM orders)
SELECT k, CASE WHEN k <> 7 THEN sum(inside) ELSE 0 END::BIGINT AS free, CASE WHEN k <> 7 THEN sum(size - inside) ELSE 0 END::BIGINT AS allocated, CASE WHEN k = 7 THEN sum(size) ELSE 0 END::BIGINT AS unknown FROM r GROUP BY k""",
)
both(
    "q_supersession_checked",
    lambda s, d: integrity.differences(_pairs(s, d).where("artifact_id <> 'a3'").unionByName(s.sql("SELECT 'r9' AS ingest_id, 'a1' AS artifact_id")), _pairs(s, d)),
    RECORDS + " SELECT ingest_id, artifact_id, 'recomputed' AS side FROM superseded WHERE artifact_id = 'a3' UNION ALL SELECT 'r9', 'a1', 'stored'",
)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return supersede.superseded_pairs(R.coverage(s, R.records(s, d)))


both(
    "q_whole_overview",
    lambda s, d: stats.whole_overview(R.records(s, d), _pairs(s, d), R.runs(s), integrity.chain_breaks(read(s, d, "events").where("event_id % 100 <> 0").select("user_id", "event_id"), "user_id", "event_id")).withColumn("outcomes", F.to_json("outcomes")),
    RECORDS + """, g AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE event_id % 100 <> 0)
SELECT count(*) AS n, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE recovered) AS recovered, count(*) FILTER (WHERE ts IS NULL) AS untimed, min(ts) AS first_ts, max(ts) AS last_ts,
(SELECT count(*) FROM records r WHERE EXISTS (SELECT 1 FROM superseded s WHERE s.ingest_id = r.ingest_id AND s.artifact_id = r.artifact_id)) AS superseded, (SELECT count(*) FROM g WHERE b IS NOT NULL AND event_id <> b + 1) AS gaps,
(SELECT '{' || string_agg('"' || outcome || '":' || n, ',' ORDER BY outcome) || '}' FROM (SELECT outcome, count(*) AS n FROM runs GROUP BY 1)) AS outcomes FROM records""",
)
LOG = "o_custkey % 30 AS log, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) AS seq, concat('e', cast(o_orderkey AS string)) AS entry"


def _log(s: SparkSession, d: str) -> DataFrame:
    """Logs of entries with their digest and that of the entry before; some digests are wrong, and some entries are left out."""
    rows = s.sql(f"SELECT {LOG} FROM {{orders}}", orders=read(s, d, "orders"))
    rows = rows.withColumn("digest", F.when(F.col("seq") % 40 == 7, "bad").otherwise(F.sha2(F.concat_ws("|", "seq", "entry"), 256)))
    before = rows.select("log", (F.col("seq") + 1).alias("seq"), F.col("digest").alias("previous"))
    return rows.join(before, ["log", "seq"], "left").withColumn("previous", F.when(F.col("seq") % 50 == 0, "bad").otherwise(F.coalesce("previous", F.lit("")))).where("seq % 60 <> 59")


both(
    "q_audit_log",
    lambda s, d: reconcile.audit_chain(_log(s, d), "log", "seq", "previous", "digest", ["seq", "entry"]).select("log", "seq", "state"),
    f"WITH l AS (SELECT {LOG} FROM orders) SELECT log, seq, CASE WHEN seq % 60 = 0 THEN 'gap' WHEN seq % 50 = 0 THEN 'unlinked' ELSE 'altered' END AS state FROM l WHERE seq % 60 <> 59 AND (seq % 60 = 0 OR seq % 50 = 0 OR seq % 40 = 7)",
)

# Payloads, texts and locators.
PAYLOAD = "concat('{{\"b\": ', cast(c_custkey AS string), ', \"a\": [1,  2.50, \"', c_mktsegment, '\"], \"c\": {{\"z\": null, \"y\": true}}}}')".replace("{{", "{").replace("}}", "}")
both(
    "q_canonical_json",
    lambda s, d: read(s, d, "customer").selectExpr("c_custkey", f"{PAYLOAD} AS p").select("c_custkey", payloads.canonical(F.col("p")).alias("payload")),
    "SELECT c_custkey, '{\"a\":[1,2.50,\"' || c_mktsegment || '\"],\"b\":' || c_custkey || ',\"c\":{\"y\":true,\"z\":null}}' AS payload FROM customer",
)
both(
    "q_schema_violations",
    lambda s, d: read(s, d, "customer").selectExpr("c_custkey", "to_json(named_struct('direction', CASE WHEN c_custkey % 5 = 0 THEN 'up' ELSE 'in' END, 'body', CASE WHEN c_custkey % 7 <> 0 THEN c_name END, 'n', CASE WHEN c_custkey % 3 = 0 THEN '-1' ELSE '4' END)) AS p").select("c_custkey", payloads.violation(F.col("p"), payloads.EXAMPLE).alias("wrong")),
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'direction: not one of in, out' WHEN c_custkey % 7 = 0 THEN 'body: missing' WHEN c_custkey % 3 = 0 THEN 'n: not a number from 0' END AS wrong FROM customer",
)
both(
    "q_clean_text",
    lambda s, d: read(s, d, "customer").select("c_custkey", payloads.clean_text(F.concat(F.col("c_name").cast("binary"), F.when(F.col("c_custkey") % 4 == 0, F.unhex(F.lit("00"))).when(F.col("c_custkey") % 4 == 1, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("C3A9"))), F.concat("c_mktsegment", "c_mktsegment").cast("binary")), 30).alias("x")).select("c_custkey", "x.text", "x.invalid", "x.nul", "x.cut"),
    """WITH x AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 4 <= 1 THEN chr(65533) ELSE 'é' END || c_mktsegment || c_mktsegment AS t, strlen(c_name) + CASE WHEN c_custkey % 4 <= 1 THEN 3 ELSE 2 END + 2 * strlen(c_mktsegment) AS bytes, CASE WHEN c_custkey % 4 <= 1 THEN 2 ELSE 1 END AS more FROM customer)
SELECT c_custkey, CASE WHEN bytes > 30 THEN substr(t, 1, 30 - more) ELSE t END AS text, c_custkey % 4 = 1 AS invalid, c_custkey % 4 = 0 AS nul, bytes > 30 AS cut FROM x""",
)
both(
    "q_type_summaries",
    lambda s, d: read(s, d, "conversations").select("conv_id", "turn", payloads.message_summary(F.lit("chat"), F.when(F.col("role") == "user", "out").otherwise("in"), F.col("role"), F.col("text")).alias("summary")),
    r"SELECT conv_id, turn, 'chat ' || CASE role WHEN 'user' THEN 'out' ELSE 'in' END || ' ' || role || ': ' || CASE WHEN length(x) <= 80 THEN x ELSE substr(x, 1, 77) || '...' END AS summary FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\p{Z}\p{Cc}]+', ' ', 'g')) AS x FROM conversations)",
)
both(
    "q_locators",
    lambda s, d: read(s, d, "part").select("p_partkey", payloads.locator("sqlite", {"table": F.col("p_type"), "rowid": F.col("p_partkey").cast("string")}).alias("locator")),
    "SELECT p_partkey, 'sqlite:table=' || replace(replace(p_type, '%', '%25'), ' ', '%20') || ';rowid=' || p_partkey AS locator FROM part",
)
both(
    "q_event_ends",
    lambda s, d: read(s, d, "orders").selectExpr("o_orderkey", "unix_micros(cast(o_orderdate AS timestamp)) AS t").select("o_orderkey", payloads.event_end(F.col("t"), F.when(F.col("o_orderkey") % 3 == 0, F.col("t") + 60_000_000), F.when(F.col("o_orderkey") % 3 == 1, F.lit(3600)), F.col("o_orderkey") % 2 == 0).alias("x")).select("o_orderkey", "x.end_us", "x.how"),
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN epoch_us(o_orderdate) + 60000000 WHEN 1 THEN epoch_us(o_orderdate) + 3600000000 ELSE CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) + 86400000000 END END AS end_us, CASE o_orderkey % 3 WHEN 0 THEN 'stored' WHEN 1 THEN 'duration' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'all-day' ELSE 'none' END END AS how FROM orders",
)
both(
    "q_time_display",
    lambda s, d: read(s, d, "orders").selectExpr("o_orderkey", "unix_micros(cast(o_orderdate AS timestamp)) + 37 AS t").select("o_orderkey", V.displayed(F.col("t"), F.when(F.col("o_orderkey") % 3 == 0, "utc").when(F.col("o_orderkey") % 3 == 1, "local").otherwise("offset"), F.lit(-90)).alias("shown")),
    "SELECT o_orderkey, strftime(make_timestamp(epoch_us(o_orderdate) + 37), '%Y-%m-%d %H:%M:%S.%f') || CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '~local' ELSE '~local-01:30' END AS shown FROM orders",
)
both(
    "q_list_caps",
    lambda s, d: read(s, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.col("l_orderkey"))).alias("a")).select("l_partkey", payloads.capped(F.col("a"), 3).alias("x")).select("l_partkey", F.array_join("x.items", ",").alias("items"), "x.total", "x.truncated"),
    "WITH a AS (SELECT l_partkey, list_sort(list(l_orderkey)) AS a FROM lineitem GROUP BY 1) SELECT l_partkey, array_to_string(a[1:3], ',') AS items, len(a) AS total, len(a) > 3 AS truncated FROM a",
)
both(
    "q_carve_files",
    lambda s, d: carve.carve(read(s, d, "pages").select("page_id", F.concat(F.unhex(F.lit("FFD8FF")), F.col("html").cast("binary"), F.unhex(F.lit("FFD9")), F.lit("x%PDF-1").cast("binary"), F.col("url").cast("binary"), F.lit("%%EOF").cast("binary"), F.unhex(F.lit("89504E470D0A1A0A"))).alias("b")), "page_id", "b"),
    "SELECT page_id, 'jpeg' AS signature, 0::BIGINT AS start, strlen(html) + 5 AS size FROM pages UNION ALL SELECT page_id, 'pdf', strlen(html) + 6, strlen(url) + 11 FROM pages",
)
