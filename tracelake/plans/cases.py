"""Registered queries of manifests, artifacts, ingests, versions and names, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import cells, payloads
from tracelake.functions import values as V
from tracelake.mappings import browsers, registry
from tracelake.mappings.joins import diagnostics
from tracelake.operators import filters, integrity, intervals, listing, reconcile, supersede, versions
from tracelake.plans import apps  # noqa: F401  (adds the app tables)
from tracelake.plans.mapped import SQL as MAPPED_SQL
from tracelake.plans.mapped import app_table, case
from tracelake.plans.searched import RECORDS
from tracelake.sources import manifest, records, sink
from tracelake.sources.staging import new_path

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def both(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name], SQL[name] = run, sql


def read(spark: SparkSession, d: str, table: str, columns: str | None = None) -> DataFrame:
    """A table, or columns of it in SQL of both engines."""
    t = spark.read.parquet(f"{d}/{table}.parquet")
    if columns is None:
        return t
    columns = columns.replace(" // ", " DIV ").replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT {columns} FROM {{t}}", t=t)


LINE = """page_id, concat('{"id":"', cast(page_id AS string), '","path":"', url, '"', CASE page_id % 11 WHEN 1 THEN ',"id":"x"' WHEN 2 THEN ',"more":1' WHEN 3 THEN '' ELSE ',"kind":"file"' END, ',"size":', CASE page_id % 11 WHEN 4 THEN '-5' WHEN 5 THEN '"many"' ELSE cast(page_id AS string) END, ',"sha256":"', CASE WHEN page_id % 11 = 6 THEN 'zz' ELSE repeat('0123456789abcdef', 4) END, '"', CASE WHEN page_id % 11 = 7 THEN '' ELSE '}' END) AS line"""
both(
    "q_manifest_lines", lambda s, d: manifest.parsed(read(s, d, "pages", LINE), "line").select("page_id", "state", F.when(F.col("state") == "ok", F.col("size")).alias("size")),
    "SELECT page_id, ['ok', 'repeated-key', 'unknown-key', 'missing', 'bad-value', 'bad-value', 'bad-value', 'not-json', 'ok', 'ok', 'ok'][page_id % 11 + 1] AS state, CASE WHEN page_id % 11 IN (0, 8, 9, 10) THEN page_id END AS size FROM pages",
)
KINDS = "page_id, CASE page_id % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'backup' WHEN 2 THEN 'extract' WHEN 3 THEN 'carve' WHEN 4 THEN 'serial' END AS kind, CASE WHEN page_id % 4 = 0 THEN 's' END AS snapshot, page_id % 7 = 0 AS gone"
both(
    "q_eligible", lambda s, d: read(s, d, "pages", KINDS).select("page_id", manifest.eligible(F.col("kind"), F.col("snapshot"), F.col("gone")).alias("why"), manifest.eligible(F.col("kind"), F.col("snapshot"), F.col("gone"), True, True).alias("why_if_all")),
    f"SELECT page_id, CASE WHEN kind IS NULL THEN 'no kind' WHEN kind IN ('file', 'backup') THEN NULL WHEN kind = 'extract' THEN CASE WHEN snapshot IS NOT NULL THEN 'snapshot' WHEN gone THEN 'recovered' END WHEN kind = 'carve' THEN 'recovered' ELSE 'kind ' || kind END AS why, CASE WHEN kind IS NULL THEN 'no kind' WHEN kind = 'serial' THEN 'kind serial' END AS why_if_all FROM (SELECT {KINDS} FROM pages)",
)
NAMED = "cast(page_id % 400 AS string) AS id, url AS path, CASE WHEN page_id % 5 = 1 THEN '0' ELSE sha256(html) END AS sha256"
both(
    "q_artifact_open", lambda s, d: manifest.opened(read(s, d, "pages", "cast(page_id AS string) AS id"), read(s, d, "pages", NAMED.replace("sha256(html)", "sha2(html, 256)")), read(s, d, "pages").where("page_id % 9 <> 2").select(F.col("url").alias("path"), "html"), "html").select("id", "state", F.length("content").cast("bigint").alias("n")),
    f"WITH m AS (SELECT {NAMED} FROM pages), o AS (SELECT id, count(*) AS n, min(path) AS path, min(sha256) AS h FROM m GROUP BY 1), f AS (SELECT url AS path, html FROM pages WHERE page_id % 9 <> 2) SELECT p.page_id::VARCHAR AS id, CASE WHEN o.n IS NULL THEN 'unknown' WHEN o.n > 1 THEN 'ambiguous' WHEN f.path IS NULL THEN 'absent' WHEN sha256(html) = h THEN 'ok' ELSE 'altered' END AS state, CASE WHEN o.n = 1 AND sha256(html) = h THEN length(html) END AS n FROM (SELECT page_id FROM pages) p LEFT JOIN o ON o.id = p.page_id::VARCHAR LEFT JOIN f ON f.path = o.path",
)
BACKUP = "concat('Domain', cast(c_nationkey AS string)) AS domain, c_name AS relativePath, CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE sha1(concat('Domain', cast(c_nationkey AS string), '-', c_name)) END AS fileID, CASE c_custkey % 7 WHEN 0 THEN 2 ELSE 1 END AS flags"
both(
    "q_backup_files", lambda s, d: manifest.backup_files(read(s, d, "customer", BACKUP), read(s, d, "customer", "c_custkey, sha1(concat('Domain', cast(c_nationkey AS string), '-', c_name)) AS name").where("c_custkey % 5 <> 0")),
    f"WITH r AS (SELECT c_custkey, {BACKUP} FROM customer) SELECT domain, relativePath AS path, fileID AS file_id, CASE WHEN flags <> 1 THEN 'no-file' WHEN c_custkey % 9 = 0 THEN 'renamed' WHEN c_custkey % 5 = 0 THEN 'missing' ELSE 'found' END AS state FROM r",
)
both(
    "q_runs_sidecar", lambda s, d: intervals.merge_runs(manifest.runs_of(read(s, d, "lineitem").groupBy("l_suppkey").agg(F.to_json(F.collect_list(F.struct((F.col("l_orderkey") * 10).alias("offset"), (F.col("l_quantity").cast("bigint") * 3 - 9).alias("length")))).alias("line")), "l_suppkey", "line"), "l_suppkey"),
    "WITH r AS (SELECT l_suppkey, l_orderkey * 10 AS start, l_orderkey * 10 + l_quantity::BIGINT * 3 - 9 AS stop FROM lineitem WHERE l_quantity::BIGINT > 3), m AS (SELECT *, max(stop) OVER (PARTITION BY l_suppkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r), n AS (SELECT *, sum(CASE WHEN b >= start THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT l_suppkey, min(start) AS start, max(stop) AS stop FROM n GROUP BY l_suppkey, i",
)
FRAMES = "l_suppkey % 50 AS file, l_partkey % 40 AS page, l_orderkey * 8 + l_linenumber AS seq, concat('c', cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS content, l_orderkey % 97 = 0 AS commits"
BASE = "s_suppkey % 50 AS file, s_suppkey // 50 AS page, concat('b', cast(s_suppkey AS string)) AS content"
both(
    "q_page_views", lambda s, d: versions.views(read(s, d, "supplier", BASE), read(s, d, "lineitem", FRAMES)),
    f"WITH b AS (SELECT {BASE} FROM supplier), f AS (SELECT {FRAMES} FROM lineitem), l AS (SELECT file, max(seq) FILTER (WHERE commits) AS last FROM f GROUP BY 1), n AS (SELECT f.file, page, arg_max(content, seq) AS a, arg_max(content, seq) FILTER (WHERE seq <= last) AS v, count(*) AS k FROM f LEFT JOIN l USING (file) GROUP BY 1, 2) SELECT file, page, coalesce(a, content) AS as_found, coalesce(v, content) AS live, coalesce(k, 0) AS versions FROM b FULL JOIN n USING (file, page)",
)
both(
    "q_recovered_relations", lambda s, d: versions.relations(read(s, d, "orders", "o_orderkey AS k, o_orderstatus AS v, o_custkey AS w").where("k % 3 <> 0"), read(s, d, "orders", "o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS v, o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS w").where("k % 5 <> 0"), ["k"], ["v", "w"]),
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'recovered-only' WHEN o_orderkey % 5 = 0 THEN 'live-only' WHEN o_orderkey % 11 = 0 THEN 'differs' WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'equal' END AS relation FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0",
)
both(
    "q_recovered_tallies", lambda s, d: records.records(s, d).where("ingest_id = 'r0' AND recovered").groupBy("type").agg(F.count("*").alias("n")),
    RECORDS + " SELECT type, count(*) AS n FROM records WHERE ingest_id = 'r0' AND recovered GROUP BY 1",
)


def ingested(s: SparkSession, d: str) -> DataFrame:
    """Two ingests: one whose records are accepted but for some, and one with too many wrong ones."""
    recs = records.records(s, d).where("type = 'account'").select("id", "type", "artifact_id", "confidence")
    wrong = lambda most: F.when((F.col("confidence") > most), "confidence above the most")
    path = new_path(s, "case")
    one = sink.ingest(recs, path, "i1", wrong(90), ["id", "type", "artifact_id"], 500)
    two = sink.ingest(recs.where("confidence IS NOT NULL"), path, "i2", wrong(20), ["id", "type", "artifact_id"], 500)
    return one.union(two).withColumn("open", F.lit(sink.interrupted(s, path).count()))


both(
    "q_ingest_outcomes", ingested,
    RECORDS + ", a AS (SELECT * FROM records WHERE type = 'account') SELECT 'i1' AS ingest_id, 'complete' AS outcome, count(*) FILTER (WHERE coalesce(confidence, 0) <= 90) AS accepted, count(*) FILTER (WHERE confidence > 90) AS rejected, count(DISTINCT (id - 1) // 500) FILTER (WHERE coalesce(confidence, 0) <= 90) AS batches, 0 AS open FROM a UNION ALL SELECT 'i2', 'aborted', count(*) FILTER (WHERE confidence <= 20), count(*) FILTER (WHERE confidence > 20), 0, 0 FROM a",
)
PATHS = "o_orderkey AS k, concat('/data/', CASE o_custkey % 4 WHEN 0 THEN 'com.android.chrome' WHEN 1 THEN 'com.brave.browser_beta' WHEN 2 THEN 'org.other' ELSE 'com.whatsapp' END, CASE o_orderkey % 4 WHEN 0 THEN '/app_chrome/Default/History' WHEN 1 THEN '/app_webview/P1/History' WHEN 2 THEN '/databases/msgstore.db' ELSE '/app_chrome/x' END) AS path"
both(
    "q_browser_labels", lambda s, d: read(s, d, "orders", PATHS).select("k", browsers.label(F.col("path")).alias("l")).select("k", "l.*"),
    f"WITH p AS (SELECT {PATHS}, o_custkey % 4 AS c, o_orderkey % 4 AS e FROM orders) SELECT k, CASE WHEN e = 2 THEN 'unknown-chromium' WHEN e = 1 THEN 'webview' ELSE ['chrome', 'brave', 'unknown-chromium', 'unknown-chromium'][c + 1] END AS browser, CASE e WHEN 0 THEN 'Default' WHEN 1 THEN 'P1' ELSE '' END AS profile, CASE WHEN e = 2 THEN '' ELSE split_part(path, '/', 3) END AS package FROM p",
)
both(
    "q_file_namers", lambda s, d: registry.named(read(s, d, "orders", PATHS), "path").groupBy("parser").agg(F.count("*").alias("n")),
    f"SELECT CASE WHEN path LIKE '%/History' THEN 'chromium.history' WHEN path LIKE '%/com.whatsapp/databases/msgstore.db' THEN 'android.whatsapp.msgstore' END AS parser, count(*) AS n FROM (SELECT {PATHS} FROM orders) GROUP BY 1",
)
both(
    "q_download_names", lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", browsers.danger_name(F.col("l_suppkey") % 30).alias("danger"), browsers.interrupt_name(F.col("l_partkey") % 55).alias("why")),
    f"SELECT l_orderkey, l_linenumber, {case('l_suppkey % 30', dict(enumerate(browsers.DANGERS)))} AS danger, {case('l_partkey % 55', browsers.INTERRUPTS)} AS why FROM lineitem",
)
both(
    "q_rejected_payloads",
    lambda s, d: registry.rejected(registry.records(registry.PARSERS["ios.calls"], {"ZCALLRECORD": app_table(s, d, "ZCALLRECORD")}).withColumn("type", F.when(F.col("rowid") % 10 == 0, "calls").otherwise(F.col("type"))).withColumn("payload", F.when(F.col("rowid") % 7 == 0, F.replace("payload", F.lit('"direction":"out"'), F.lit('"direction":"up"'))).otherwise(F.col("payload")))).select("rowid", "wrong"),
    MAPPED_SQL["q_map_ios_calls"].split(" SELECT Z_PK AS rowid", 1)[0] + " SELECT Z_PK AS rowid, CASE WHEN Z_PK % 10 = 0 THEN 'unknown type' ELSE 'direction: not one of in, out, unknown' END AS wrong FROM a_ZCALLRECORD WHERE Z_PK % 10 = 0 OR (Z_PK % 7 = 0 AND ZORIGINATED = 1)",
)
both(
    "q_local_names", lambda s, d: read(s, d, "part").select("p_partkey", payloads.local_name(F.concat(F.when(F.col("p_partkey") % 3 == 0, "con.").otherwise("a:b"), F.col("p_name"))).alias("name"), payloads.logical_path(F.concat(F.lit("/x/./"), F.col("p_brand"), F.when(F.col("p_partkey") % 4 == 0, "/../y").otherwise("//y/"))).alias("path")),
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '_con.' ELSE 'a_b' END || p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN '/x/' || p_brand || '/y' END AS path FROM part",
)

# Whole rows, joins' outcomes, identifiers, mixed cells.
both(
    "q_whole_rows", lambda s, d: records.whole(records.records(s, d).where("type IN ('account', 'calendar_event')"), supersede.superseded_pairs(records.coverage(s, records.records(s, d)))),
    RECORDS + """ SELECT id, type, 1 AS payload_v, artifact_id, source_path, 'sqlite:table=' || type || ';rowid=' || id AS locator, (id - 1) % 65536 * 64 AS src_offset, 64 AS src_length, ts, CASE WHEN type = 'calendar_event' THEN ts + 3600000000 END AS ts_end, CASE WHEN ts IS NOT NULL THEN 'utc' END AS ts_basis, CASE WHEN ts IS NOT NULL THEN 0 END AS tz_offset_min,
deleted, recovered, CASE WHEN recovered THEN 'freelist' END AS recovery_method, confidence, parser_name, parser_version, sha256(concat_ws('/', parser_name, parser_version)) AS parser_hash, summary, ingest_id, EXISTS (SELECT 1 FROM superseded x WHERE x.ingest_id = rp.ingest_id AND x.artifact_id = rp.artifact_id) AS superseded
FROM rp WHERE type IN ('account', 'calendar_event')""",
)
both(
    "q_join_diagnostics", lambda s, d: diagnostics(registry.PARSERS["ios.calendar"].run({n: app_table(s, d, n) for n in registry.PARSERS["ios.calendar"].needs}), ["calendar_state", "location_state"]),
    f"WITH c AS ({MAPPED_SQL['q_map_ios_calendar']}) SELECT 'calendar' AS \"join\", calendar_state AS state, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'location', location_state, count(*) FROM c GROUP BY 2",
)
REFS, HELD = "o_orderkey AS id, concat('/a/', cast(o_custkey % 500 AS string)) AS path, o_orderkey % 3 AS source", "concat('/a/', cast(l_partkey % 700 AS string)) AS path, l_suppkey % 4 AS source"
both(
    "q_located_files", lambda s, d: reconcile.located(read(s, d, "orders", REFS), read(s, d, "lineitem", HELD + ", l_linenumber, l_partkey").where("l_linenumber = 7 AND l_partkey % 3 <> 0").select("path", "source"), "path", "source"),
    f"WITH f AS (SELECT {HELD} FROM lineitem WHERE l_linenumber = 7 AND l_partkey % 3 <> 0), b AS (SELECT path, source, count(*) AS k FROM f GROUP BY 1, 2), a AS (SELECT path, sum(k)::BIGINT AS files FROM b GROUP BY 1), r AS (SELECT {REFS} FROM orders) SELECT r.*, CASE WHEN k = 1 THEN 'found' WHEN k > 1 THEN 'ambiguous' WHEN files IS NOT NULL THEN 'other-source' ELSE 'unresolved' END AS state, coalesce(files, 0) AS files FROM r LEFT JOIN a ON a.path = r.path LEFT JOIN b ON b.path = r.path AND b.source = r.source",
)
both(
    "q_orphans", lambda s, d: reconcile.orphans(read(s, d, "lineitem", "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_orderkey END AS k, l_linenumber"), "k", read(s, d, "orders").where("o_orderstatus <> 'F'"), "o_orderkey"),
    "SELECT CASE WHEN l_linenumber = 4 THEN NULL ELSE l_orderkey END AS k, l_linenumber FROM lineitem WHERE l_linenumber = 4 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')",
)
both(
    "q_ingest_rollup", lambda s, d: integrity.rollup(integrity.batch_digest(records.records(s, d).where("type = 'account'"), ["id", "type"], 500).withColumn("part", F.col("batch_no") % 3), "part"),
    RECORDS + ", g AS (SELECT id, (id - 1) // 500 AS batch_no, sha256('1:' || strlen(id::VARCHAR) || ':' || id || '1:' || strlen(type) || ':' || type) AS x FROM records WHERE type = 'account'), b AS (SELECT batch_no, sha256(string_agg(x, '' ORDER BY id, x)) AS d FROM g GROUP BY 1) SELECT batch_no % 3 AS part, count(*) AS batches, sha256(string_agg(d, '' ORDER BY batch_no)) AS digest FROM b GROUP BY 1",
)
JIDS = "c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN concat('u', cast(c_custkey AS string), '@s.whatsapp.net') WHEN 1 THEN concat('u', cast(c_custkey AS string), '.3:7@lid') WHEN 2 THEN 'nobody' WHEN 3 THEN '@g.us' WHEN 4 THEN 'a@' WHEN 5 THEN 'a:70000@g.us' WHEN 6 THEN 'status@broadcast' WHEN 7 THEN 'a@b@newsletter' ELSE 'a.300:1@x' END AS j"
both(
    "q_jids", lambda s, d: read(s, d, "customer", JIDS).select("k", V.jid(F.col("j")).alias("x")).select("k", "x.state", "x.user", F.col("x.agent").cast("bigint").alias("agent"), F.col("x.device").cast("bigint").alias("device"), "x.server", "x.class"),
    """SELECT c_custkey AS k, ['ok', 'ok', 'no-server', 'empty-user', 'empty-server', 'bad-suffix', 'ok', 'ok', 'bad-suffix'][c_custkey % 9 + 1] AS state, CASE c_custkey % 9 WHEN 0 THEN 'u' || c_custkey WHEN 1 THEN 'u' || c_custkey WHEN 6 THEN 'status' WHEN 7 THEN 'a@b' END AS "user", CASE c_custkey % 9 WHEN 1 THEN 3 END AS agent, CASE c_custkey % 9 WHEN 1 THEN 7 END AS device,
CASE c_custkey % 9 WHEN 0 THEN 's.whatsapp.net' WHEN 1 THEN 'lid' WHEN 6 THEN 'broadcast' WHEN 7 THEN 'newsletter' END AS server, CASE c_custkey % 9 WHEN 0 THEN 'user' WHEN 1 THEN 'lid' WHEN 6 THEN 'status' WHEN 7 THEN 'newsletter' END AS "class" FROM customer""",
)
COCOA = "o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 9223372036854775807 WHEN 2 THEN o_custkey + 1 WHEN 3 THEN (o_custkey + 1) * 100000000000 ELSE 99999999999 END AS v"
both(
    "q_cocoa_units", lambda s, d: read(s, d, "orders", COCOA).select("k", V.cocoa_auto(F.col("v")).alias("x")).select("k", "x.*"),
    f"SELECT k, CASE k % 5 WHEN 2 THEN v * 1000000 + 978307200000000 WHEN 3 THEN CASE WHEN v // 1000 + 978307200000000 < 4102444800000000 THEN v // 1000 + 978307200000000 END END AS us, CASE WHEN k % 5 IN (1, 3) THEN 'ns' WHEN k % 5 = 4 THEN 's' ELSE 's' END AS unit, CASE WHEN k % 5 IN (0, 1) THEN 'sentinel' WHEN k % 5 = 2 OR (k % 5 = 3 AND v // 1000 + 978307200000000 < 4102444800000000) THEN 'valid' ELSE 'invalid' END AS \"class\" FROM (SELECT {COCOA} FROM orders)",
)
both(
    "q_mixed_extremes",
    lambda s, d: read(s, d, "lineitem").where("l_linenumber <= 4").groupBy("l_orderkey").agg(*[f(cells.order_key(_mixed())).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]).select("l_orderkey", F.col("lo.kind").cast("bigint").alias("lo_kind"), F.col("lo.near").alias("lo"), F.col("hi.kind").cast("bigint").alias("hi_kind"), F.decode("hi.t", "UTF-8").alias("hi")),
    "WITH c AS (SELECT l_orderkey, [1, 1, 2, 0][l_linenumber] AS kind, CASE l_linenumber WHEN 1 THEN l_partkey::DOUBLE WHEN 2 THEN l_extendedprice::DOUBLE END AS x, CASE l_linenumber WHEN 3 THEN l_returnflag END AS t FROM lineitem WHERE l_linenumber <= 4) SELECT l_orderkey, min(kind)::BIGINT AS lo_kind, CASE WHEN min(kind) = 1 THEN min(x) END AS lo, max(kind)::BIGINT AS hi_kind, CASE WHEN max(kind) = 2 THEN max(t) END AS hi FROM c GROUP BY 1",
)


def _mixed() -> Column:
    n = F.col("l_linenumber")
    return cells.cell(F.when(n == 1, F.col("l_partkey")), F.when(n == 2, F.col("l_extendedprice")), F.when(n == 3, F.col("l_returnflag")))


# Filters and anti joins that keep some rows and leave out others.
ODD = "translate(source_path, '-u', '_%')"
both(
    "q_filter_prefix_of_wildcards", lambda s, d: filters.apply(records.records(s, d).withColumn("source_path", F.expr(ODD)), filters.Filter(path_prefix="/data/p%rchase/1")).select("id", "source_path"),
    RECORDS + f" SELECT id, {ODD} AS source_path FROM records WHERE starts_with({ODD}, '/data/p%rchase/1')",
)
both(
    "q_visitless_pages", lambda s, d: reconcile.orphans(app_table(s, d, "urls"), "id", app_table(s, d, "visits").where("id % 7 = 0"), "url").select("id", "url"),
    MAPPED_SQL["q_map_chromium_visits"].split(", u AS (SELECT", 1)[0] + " SELECT id, url FROM a_urls WHERE id NOT IN (SELECT url FROM a_visits WHERE id % 7 = 0)",
)
both(
    "q_list_newest_of_many", lambda s, d: listing.page(filters.apply(records.records(s, d), filters.Filter(types=("event", "account", "web_visit"), artifact_ids=("a1", "a2"), min_confidence=50)), 150, True),
    RECORDS + f" SELECT {', '.join(listing.LIST_COLUMNS)} FROM records WHERE type IN ('event', 'account', 'web_visit') AND artifact_id IN ('a1', 'a2') AND confidence >= 50 ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 150",
)
