"""Registered queries of the record engine, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.functions import values as V
from tracelake.operators import filters, integrity, intervals, listing, stats, supersede
from tracelake.operators.filters import Filter
from tracelake.plans import appended, apps, cases, covered, mapped, planned, searched, unknowns, verified
from tracelake.sources import records as R

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SLIM = "id, type, artifact_id, ts, deleted"
WITH = "WITH " + R.sql_records() + " "
T0, T1 = 1_704_067_200_000_000, 1_711_929_600_000_000  # 2024-01-01, 2024-04-01


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = run
    if sql is not None:
        SQL[name] = sql


def _filter(name: str, f: Filter, where: str, table: str = "records") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        recs = R.records(spark, d)
        hidden = None if f.include_superseded else supersede.superseded_pairs(R.coverage(spark, recs))
        return filters.apply(recs, f, hidden).selectExpr(*SLIM.split(", "))

    register(name, run, f"{WITH} SELECT {SLIM} FROM {table} WHERE {where}")


_filter("q_filter_type", Filter(types=("account",)), "type = 'account'")
_filter("q_filter_types_multi", Filter(types=("event", "app_event", "event")), "type IN ('event', 'app_event')")
_filter("q_filter_artifact", Filter(artifact_ids=("a3", "c1")), "artifact_id IN ('a3', 'c1')")
_filter("q_filter_time_range", Filter(from_us=T0, to_us=T1), f"ts >= {T0} AND ts < {T1}")
_filter("q_filter_time_untimed", Filter(types=("account", "message"), from_us=T0, to_us=T1, include_untimed=True), f"type IN ('account', 'message') AND (ts >= {T0} AND ts < {T1} OR ts IS NULL)")
_filter("q_filter_path_prefix", Filter(path_prefix="/orders/1-"), "starts_with(source_path, '/orders/1-')")
_filter("q_filter_path_prefix_literal", Filter(path_prefix="/data/%_"), "starts_with(source_path, '/data/%_')")
_filter("q_filter_deleted_only", Filter(deleted=True, types=("web_visit", "event")), "deleted AND type IN ('web_visit', 'event')")
_filter("q_filter_recovered_none", Filter(recovered=False, types=("account",)), "NOT recovered AND type = 'account'")
_filter("q_filter_parser_name", Filter(parser_names=("app.chat",)), "parser_name = 'app.chat'", "rp")
_filter("q_filter_parser_version", Filter(parser_versions=(("app.events", "1.1"),)), "parser_name = 'app.events' AND parser_version = '1.1'", "rp")
_filter("q_filter_min_confidence", Filter(min_confidence=70), "confidence >= 70")
_filter("q_filter_ingest", Filter(ingest_id="r2"), "ingest_id = 'r2'")
_filter("q_filter_glob", Filter(path_glob="/data/*/1*"), "regexp_matches(source_path, '^/data/[^/]*/1[^/]*$')")
_filter("q_filter_glob_deep", Filter(path_glob="/**/7"), "regexp_matches(source_path, '^/([^/]*(/[^/]*)*)/7$')")
_filter("q_hide_superseded", Filter(include_superseded=False), "NOT EXISTS (SELECT 1 FROM superseded s WHERE s.ingest_id = records.ingest_id AND s.artifact_id = records.artifact_id)")

register("q_superseded_pairs", lambda s, d: supersede.superseded_pairs(R.coverage(s, R.records(s, d))), WITH + "SELECT ingest_id, artifact_id FROM superseded")
register(
    "q_superseded_by", lambda s, d: supersede.superseded_by(R.coverage(s, R.records(s, d))),
    WITH + """SELECT c.ingest_id, c.artifact_id, arg_min(n.ingest_id, n.end_seq) AS "by" FROM coverage c JOIN runs o ON o.ingest_id = c.ingest_id JOIN parsers p ON p.parser_id = o.parser_id
    JOIN coverage e ON e.artifact_id = c.artifact_id JOIN runs n ON n.ingest_id = e.ingest_id AND n.outcome = 'complete' AND n.end_seq > o.end_seq
    JOIN parsers q ON q.parser_id = n.parser_id AND q.parser_name = p.parser_name GROUP BY 1, 2""",
)
LIST = ", ".join(listing.LIST_COLUMNS)
MIXED = Filter(types=("account", "message", "calendar_event"))
MIXED_SQL = f"SELECT {LIST} FROM records WHERE type IN ('account', 'message', 'calendar_event')"
mixed = lambda s, d: filters.apply(R.records(s, d), MIXED)
register("q_list_asc_first", lambda s, d: listing.page(mixed(s, d), 200), WITH + MIXED_SQL + " ORDER BY ts ASC NULLS LAST, id LIMIT 200")
register("q_list_asc_after", lambda s, d: listing.resume(mixed(s, d), MIXED, listing.cursor(MIXED, T0, 50, False), 300), WITH + MIXED_SQL + f" AND (ts > {T0} OR ts = {T0} AND id > 50 OR ts IS NULL) ORDER BY ts ASC NULLS LAST, id LIMIT 300")
register("q_list_desc_first", lambda s, d: listing.page(mixed(s, d), 200, True), WITH + MIXED_SQL + " ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 200")
register("q_list_desc_after_untimed", lambda s, d: listing.page(listing.after(mixed(s, d), None, 1_000_020_000, True), 500, True), WITH + MIXED_SQL + " AND (ts IS NULL AND id < 1000020000 OR ts IS NOT NULL) ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 500")
register("q_count_capped", lambda s, d: listing.count_capped(R.records(s, d), 1000), WITH + "SELECT least(count(*), 1000)::BIGINT AS n, count(*) > 1000 AS capped FROM records")
for by, key in (("type", "type"), ("parser", "coalesce(parser_name, '') || '/' || coalesce(parser_version, '')"), ("artifact", "artifact_id"), ("deleted", "CASE WHEN recovered THEN 'recovered' WHEN deleted THEN 'deleted' ELSE 'live' END"), ("run", "coalesce(ingest_id, '')")):
    register(f"q_stats_{by}", lambda s, d, by=by: stats.stats(R.with_parser(R.records(s, d)) if by == "parser" else R.records(s, d), by), WITH + f"SELECT {key} AS key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM rp GROUP BY 1")
register("q_overview", lambda s, d: stats.overview(R.records(s, d)), WITH + "SELECT count(*) AS n, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE recovered) AS recovered, count(*) FILTER (WHERE ts IS NULL) AS untimed, min(ts) AS first_ts, max(ts) AS last_ts FROM records")
register("q_overview_types", lambda s, d: stats.overview_and_types(R.records(s, d)), WITH + "SELECT type, count(*) AS n, count(*) FILTER (WHERE ts IS NULL) AS untimed, min(ts) AS first_ts, max(ts) AS last_ts FROM records GROUP BY ROLLUP (type)")
register("q_runs_by_outcome", lambda s, d: R.records(s, d).select("ingest_id").distinct().join(R.runs(s), "ingest_id").groupBy("outcome").agg(F.count("*").alias("n")), WITH + "SELECT outcome, count(*) AS n FROM (SELECT DISTINCT ingest_id FROM records) JOIN runs USING (ingest_id) GROUP BY outcome")

# Times, addresses, identifiers and enumerations.
numbers = lambda s, d: s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS k", "unix_seconds(cast(o_orderdate AS timestamp)) AS sec", "o_custkey AS c")
NUMBERS = "SELECT o_orderkey AS k, (epoch_us(o_orderdate) // 1000000)::BIGINT AS sec, o_custkey AS c FROM orders"
register("q_times_unix", lambda s, d: numbers(s, d).select("k", V.unix_us(F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("sec") * 1000), "ms").alias("us"), V.time_class(F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("sec")), V.unix_us(F.col("sec"), "s")).alias("kind")), f"SELECT k, CASE WHEN k % 5 <> 0 THEN sec * 1000000 END AS us, CASE WHEN k % 5 = 0 THEN 'sentinel' ELSE 'valid' END AS kind FROM ({NUMBERS})")
register("q_times_cocoa_auto", lambda s, d: numbers(s, d).select("k", V.cocoa_auto_us(F.when(F.col("k") % 2 == 0, F.col("sec") - V.COCOA).otherwise((F.col("sec") - V.COCOA) * 1_000_000_000)).alias("us")), f"SELECT k, CASE WHEN sec <> {V.COCOA} THEN sec * 1000000 END AS us FROM ({NUMBERS})")
register("q_times_webkit", lambda s, d: numbers(s, d).select("k", V.webkit_us((F.col("sec") - V.WEBKIT) * 1_000_000).alias("us")), f"SELECT k, sec * 1000000 AS us FROM ({NUMBERS})")
register(
    "q_address_kind", lambda s, d: s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS k", "CASE c_custkey % 5 WHEN 0 THEN concat('u', c_custkey, '@x.org') WHEN 1 THEN concat('+1 (555) 010-', lpad(c_custkey % 10000, 4, '0')) WHEN 2 THEN cast(c_custkey % 9000 + 1000 AS string) WHEN 3 THEN concat('shop', c_custkey % 100) ELSE '10.0.0.1' END AS a").select("k", V.address_kind(F.col("a")).alias("kind")),
    "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'shortcode' WHEN 3 THEN 'alnum' ELSE 'unknown' END AS kind FROM customer",
)
register(
    "q_jid_parse", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), V.jid_parts(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, ":7").otherwise(""), F.lit("@s.example"))).alias("j")).select("k", "j.user", F.col("j.device").cast("bigint").alias("device"), "j.server"),
    "SELECT c_custkey AS k, 'u' || c_custkey AS \"user\", CASE WHEN c_custkey % 3 = 0 THEN 7::BIGINT END AS device, 's.example' AS server FROM customer",
)
lines = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet")
register("q_sms_direction", lambda s, d: lines(s, d).select(V.named(F.col("l_linenumber"), V.SMS_DIRECTIONS).alias("direction")).groupBy("direction").agg(F.count("*").alias("n")), "SELECT CASE WHEN l_linenumber = 1 THEN 'in' WHEN l_linenumber = 3 THEN 'draft' WHEN l_linenumber BETWEEN 2 AND 6 THEN 'out' ELSE 'unknown' END AS direction, count(*) AS n FROM lineitem GROUP BY 1")
register("q_call_outcome", lambda s, d: lines(s, d).select(V.call_outcome(F.col("l_linenumber"), F.pmod("l_partkey", F.lit(3))).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")), "SELECT CASE WHEN l_linenumber = 2 AND l_partkey % 3 = 0 THEN 'cancelled' WHEN l_linenumber IN (1, 2, 7) THEN 'answered' WHEN l_linenumber = 3 THEN 'missed' WHEN l_linenumber = 4 THEN 'voicemail' WHEN l_linenumber = 5 THEN 'rejected' WHEN l_linenumber = 6 THEN 'blocked' ELSE 'unknown' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
register("q_transition_decode", lambda s, d: lines(s, d).select(V.transition_core(F.col("l_suppkey") + 256).alias("core")).groupBy("core").agg(F.count("*").alias("n")), "SELECT coalesce(" + repr(list(V.TRANSITIONS)) + "[(l_suppkey & 255) + 1], 'unknown') AS core, count(*) AS n FROM lineitem GROUP BY 1")
register("q_affinity", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", V.affinity(F.element_at(F.array(*map(F.lit, ["INTEGER", "varchar(20)", "BLOB", "", "double precision", "DECIMAL(10,5)"])), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("affinity")), "SELECT p_partkey, ['INTEGER', 'TEXT', 'BLOB', 'BLOB', 'REAL', 'NUMERIC'][p_partkey % 6 + 1] AS affinity FROM part")
register(
    "q_recovery_confidence", lambda s, d: lines(s, d).select(V.confidence(F.element_at(F.array(*map(F.lit, V.METHODS)), F.col("l_linenumber")), F.element_at(F.array(*map(F.lit, V.CAPS)), (F.col("l_suppkey") % 4 + 1).cast("int"))).cast("bigint").alias("c")).withColumn("band", V.band(F.col("c"))).groupBy("c", "band").agg(F.count("*").alias("n")),
    "SELECT c, CASE WHEN c >= 70 THEN 'high' WHEN c >= 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM (SELECT least([75, 70, 60, 55, 45, 45, 35, 25][l_linenumber], [100, 60, 40, 30][l_suppkey % 4 + 1])::BIGINT AS c FROM lineitem) GROUP BY 1, 2",
)

# Mappings' joins: anti joins, ordered parts, members, lookups.
register("q_visitless_anti", lambda s, d: s.read.parquet(f"{d}/customer.parquet").join(s.read.parquet(f"{d}/orders.parquet"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
register("q_thread_members", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("members"), F.count("*").alias("n")), "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS members, count(*) AS n FROM conversations GROUP BY conv_id")
register("q_mms_parts_joined", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 256).alias("body")), "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS body FROM conversations GROUP BY conv_id")
register(
    "q_attachment_lookup", lambda s, d: lines(s, d).groupBy("l_orderkey").agg(F.count("*").alias("k")).join(s.read.parquet(f"{d}/orders.parquet"), F.expr("l_orderkey = o_orderkey"), "right").select("o_orderkey", F.when(F.col("k").isNull(), "unresolved").when(F.col("k") == 1, "found").otherwise("ambiguous").alias("state")),
    "SELECT o_orderkey, CASE WHEN k IS NULL THEN 'unresolved' WHEN k = 1 THEN 'found' ELSE 'ambiguous' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)

# Byte runs.
runs_of = lambda s, d: lines(s, d).selectExpr("l_suppkey AS k", "l_orderkey * 10 AS start", "l_orderkey * 10 + cast(l_quantity AS bigint) * 40 AS stop")
RUNS_SQL = "r AS (SELECT l_suppkey AS k, l_orderkey * 10 AS start, l_orderkey * 10 + l_quantity::BIGINT * 40 AS stop FROM lineitem), m1 AS (SELECT *, max(stop) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r WHERE stop > start), m2 AS (SELECT *, sum(CASE WHEN b >= start THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM m1), m AS (SELECT k, min(start) AS start, max(stop) AS stop FROM m2 GROUP BY k, i)"
register("q_runs_merge", lambda s, d: intervals.merge_runs(runs_of(s, d), "k"), f"WITH {RUNS_SQL} SELECT k, start, stop FROM m")
register("q_runs_complement", lambda s, d: intervals.complement(intervals.merge_runs(runs_of(s, d), "k"), "k"), f"WITH {RUNS_SQL} SELECT * FROM (SELECT k, stop AS start, lead(start) OVER (PARTITION BY k ORDER BY start) AS stop FROM m) WHERE stop IS NOT NULL")
register(
    "q_range_translate",
    lambda s, d: intervals.translate(
        s.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey % 10 AS k", "o_orderkey AS id", "o_orderkey * 7 AS start", "o_orderkey * 7 + 100 AS stop"),
        lines(s, d).where("l_linenumber = 1").selectExpr("l_orderkey % 10 AS k", "l_orderkey * 7 AS at", "50L AS size", "l_orderkey * 1000 AS target"), "k", 4096),
    "WITH r AS (SELECT o_custkey % 10 AS k, o_orderkey AS id, o_orderkey * 7 AS start, o_orderkey * 7 + 100 AS stop FROM orders), e AS (SELECT l_orderkey % 10 AS k, l_orderkey * 7 AS pos, 50 AS size, l_orderkey * 1000 AS target FROM lineitem WHERE l_linenumber = 1) "
    "SELECT id, target + greatest(start, pos) - pos AS target_start, least(stop, pos + size) - greatest(start, pos) AS length FROM r JOIN e ON r.k = e.k AND start < pos + size AND stop > pos",
)

# Integrity.
register("q_row_digest", lambda s, d: R.records(s, d).where("type = 'account'").select("id", integrity.row_digest(["id", "type", "artifact_id", "confidence"]).alias("digest")), WITH + "SELECT id, sha256('1:' || strlen(id::VARCHAR) || ':' || id || '1:' || strlen(type) || ':' || type || '1:' || strlen(artifact_id) || ':' || artifact_id || CASE WHEN confidence IS NULL THEN '0;' ELSE '1:' || strlen(confidence::VARCHAR) || ':' || confidence END) AS digest FROM records WHERE type = 'account'")
register("q_batch_digest", lambda s, d: integrity.batch_digest(R.records(s, d).where("type = 'account'"), ["id", "type"], 500), WITH.removesuffix(" ") + ", g AS (SELECT id, (id - 1) // 500 AS batch_no, sha256('1:' || strlen(id::VARCHAR) || ':' || id || '1:' || strlen(type) || ':' || type) AS x FROM records WHERE type = 'account') SELECT batch_no, count(*) AS n, sha256(string_agg(x, '' ORDER BY id, x)) AS digest FROM g GROUP BY batch_no")
register("q_audit_chain", lambda s, d: integrity.chain_breaks(s.read.parquet(f"{d}/lineitem.parquet").where("l_partkey % 17 != 0").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM lineitem WHERE l_partkey % 17 <> 0) WHERE b IS NOT NULL AND l_linenumber <> b + 1")
register("q_except_both_ways", lambda s, d: integrity.differences(lines(s, d).where("l_tax < 0.07").select("l_partkey", "l_suppkey"), lines(s, d).where("l_tax > 0.01").select("l_partkey", "l_suppkey")), "SELECT *, 'stored' AS side FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_tax < 0.07 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_tax > 0.01) UNION ALL SELECT *, 'recomputed' FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_tax > 0.01 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_tax < 0.07)")
register("q_batch_overlap", lambda s, d: integrity.overlaps(lines(s, d).selectExpr("l_suppkey", "l_orderkey AS first_id", "l_orderkey + cast(l_quantity AS bigint) AS last_id"), "l_suppkey"), "SELECT l_suppkey, first_id, last_id FROM (SELECT *, max(last_id) OVER (PARTITION BY l_suppkey ORDER BY first_id, last_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT l_suppkey, l_orderkey AS first_id, l_orderkey + l_quantity::BIGINT AS last_id FROM lineitem)) WHERE b >= first_id")
register("q_orphans_anti", lambda s, d: lines(s, d).join(s.read.parquet(f"{d}/orders.parquet").where("o_orderstatus != 'F'"), F.expr("l_orderkey = o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")


def version_overlay(s: SparkSession, d: str) -> DataFrame:
    """The last version of each page: one aggregate, nothing sorted."""
    frame = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return lines(s, d).groupBy(F.col("l_partkey").alias("page")).agg(F.max_by("l_orderkey", frame).alias("content"), F.count("*").alias("versions"))


register("q_version_overlay", version_overlay, "SELECT l_partkey AS page, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS content, count(*) AS versions FROM lineitem GROUP BY 1")


def relation_live(s: SparkSession, d: str) -> DataFrame:
    """Recovered rows beside live ones: equal, differs, recovered-only or live-only."""
    o = s.read.parquet(f"{d}/orders.parquet")
    live = o.where("o_orderkey % 3 != 0").selectExpr("o_orderkey AS k", "o_orderstatus AS v")
    old = o.where("o_orderkey % 5 != 0").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS w")
    kind = F.when(F.col("_l").isNull(), "recovered-only").when(F.col("_o").isNull(), "live-only").when(F.col("v").eqNullSafe(F.col("w")), "equal").otherwise("differs")
    return live.withColumn("_l", F.lit(1)).join(old.withColumn("_o", F.lit(1)), "k", "full").groupBy(kind.alias("relation")).agg(F.count("*").alias("n"))


register("q_relation_live", relation_live, "SELECT CASE WHEN l IS NULL THEN 'recovered-only' WHEN o IS NULL THEN 'live-only' WHEN v IS NOT DISTINCT FROM w THEN 'equal' ELSE 'differs' END AS relation, count(*) AS n FROM (SELECT o_orderkey AS k, o_orderstatus AS v, 1 AS l FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS w, 1 AS o FROM orders WHERE o_orderkey % 5 <> 0) USING (k) GROUP BY 1")


def entropy(s: SparkSession, d: str) -> DataFrame:
    """Shannon entropy of each page's bytes, from a histogram by hexadecimal pairs."""
    pairs = F.regexp_extract_all(F.hex(F.col("html").cast("binary")), F.lit("..")  , F.lit(0))
    counted = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(pairs).alias("b")).groupBy("page_id", "b").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("page_id"))
    share = counted.withColumn("p", F.col("n") / total)
    return share.groupBy("page_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


register("q_entropy", entropy, "WITH h AS (SELECT page_id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS b FROM pages), c AS (SELECT page_id, b, count(*) AS n FROM h GROUP BY 1, 2), p AS (SELECT page_id, n / sum(n) OVER (PARTITION BY page_id) AS p FROM c) SELECT page_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    apps.register()
    return Q | mapped.Q | searched.Q | verified.Q | cases.Q | unknowns.Q | appended.Q | planned.Q | covered.Q


def oracle_sql() -> dict[str, str]:
    apps.register()
    return SQL | mapped.SQL | searched.SQL | verified.SQL | cases.SQL | unknowns.SQL | appended.SQL | planned.SQL | covered.SQL
