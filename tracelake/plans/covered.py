"""Registered queries of single rules over varied values: times, dates, names, summaries, index states, pages and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import payloads, texts
from tracelake.mappings import registry
from tracelake.operators import listing, reconcile, search
from tracelake.operators.filters import Filter
from tracelake.sources import records as R
from tracelake.sources.staging import new_path, staged
from tracelake.streaming import ingest, postings

from .mapped import APP, FILES, app_sql, app_table
from .searched import POSTINGS, index

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RECORDS = "WITH " + R.sql_records()
LEAST, MOST = 0, 4_102_444_800_000_000


def over(name: str, table: str, columns: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over columns of a table, in SQL of both engines; sql reads them as x."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        mine = columns.replace("{", "{{").replace("}", "}}")
        return run(spark.sql(f"SELECT {mine} FROM {{t}}", t=spark.read.parquet(f"{d}/{table}.parquet")))

    Q[name], SQL[name] = query, f"WITH x AS (SELECT {columns.replace('AS string', 'AS VARCHAR')} FROM {table}) {sql}"


PLAUSIBLE = f"CASE WHEN {{us}} >= {LEAST} AND {{us}} < {MOST} THEN {{us}} END"
over(
    "q_times_cocoa_seconds", "lineitem", "l_orderkey, l_linenumber, CASE l_partkey % 9 WHEN 0 THEN cast('NaN' AS double) WHEN 1 THEN cast(0 AS double) WHEN 2 THEN cast(-1 AS double) WHEN 3 THEN floor(l_extendedprice) * 10000000 WHEN 4 THEN cast('-Infinity' AS double) WHEN 5 THEN -floor(l_extendedprice) * 20000 ELSE floor(l_extendedprice) * 8000 + l_quantity / 8 END AS v",
    lambda t: t.select("l_orderkey", "l_linenumber", texts.cocoa_us(F.col("v").cast("double")).alias("us")),
    "SELECT l_orderkey, l_linenumber, (" + PLAUSIBLE.format(us="u") + ")::BIGINT AS us FROM (SELECT *, CASE WHEN NOT isnan(v) AND abs(v) <= 1e11 AND v NOT IN (0, -1) THEN floor(v * 1e6)::HUGEINT + 978307200000000 END AS u FROM x)",
)
over(
    "q_times_since_1973", "lineitem", "l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN l_partkey * 100000 WHEN 1 THEN l_partkey * 1000000000 WHEN 2 THEN l_suppkey * 94694400000 - l_partkey ELSE -l_partkey END AS v",
    lambda t: t.select("l_orderkey", "l_linenumber", texts.guarded_ms_us(F.col("v").cast("bigint")).alias("us")),
    "SELECT l_orderkey, l_linenumber, CASE WHEN v >= 94694400000 AND v < 1125899906842624 THEN " + PLAUSIBLE.format(us="(v * 1000)") + " END AS us FROM x",
)
over(
    "q_real_dates", "lineitem", "l_orderkey, l_linenumber, concat(CASE l_suppkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '1' ELSE cast(1900 + l_partkey % 200 AS string) END, '-', lpad(cast(l_orderkey % 14 AS string), 2, '0'), '-', lpad(cast(l_partkey % 33 AS string), 2, '0')) AS v",
    lambda t: t.select("l_orderkey", "l_linenumber", F.coalesce(texts.real_date(F.col("v")), F.lit(False)).alias("is_date")),
    "SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN v WHEN regexp_full_match(v, '--[0-9]{2}-[0-9]{2}') THEN '2000' || v[2:] END AS DATE) IS NOT NULL, false) AS is_date FROM x",
)
over(
    "q_reaction_targets", "orders", "o_orderkey, concat(CASE o_orderkey % 5 WHEN 0 THEN 'p:0/' WHEN 1 THEN 'bp:' WHEN 2 THEN 'p:/' WHEN 3 THEN 'p:12/' ELSE '' END, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'A' END, substring(sha2(cast(o_orderkey AS string), 256), 1, 7), '-', substring(sha2(o_orderpriority, 256), 1, 4), '-1a2B-3c4D-', CASE o_custkey % 3 WHEN 0 THEN '0123456789ab' WHEN 1 THEN '0123456789abc' ELSE 'ABCDEFABCDEF' END) AS v",
    lambda t: t.select("o_orderkey", texts.target_guid(F.col("v")).alias("target")),
    "SELECT o_orderkey, CASE WHEN regexp_full_match(s, '[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}') THEN s END AS target FROM (SELECT *, regexp_replace(v, '^(p:[0-9]+/|bp:)', '') AS s FROM x)",
)
SQL["q_reaction_targets"] = SQL["q_reaction_targets"].replace("sha2(cast(o_orderkey AS VARCHAR), 256)", "sha256(o_orderkey::VARCHAR)").replace("sha2(o_orderpriority, 256)", "sha256(o_orderpriority)")
over(
    "q_labels_unwrapped", "orders", "o_orderkey, concat(CASE WHEN o_orderkey % 3 = 0 THEN '_$!<' ELSE '' END, o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN '>!$_' ELSE '>' END) AS v",
    lambda t: t.select("o_orderkey", texts.unwrap_label(F.col("v")).alias("label")),
    "SELECT o_orderkey, CASE WHEN v LIKE '$_$!<%>!$$$_' ESCAPE '$' OR (starts_with(v, '_$!<') AND ends_with(v, '>!$_')) THEN v[5:-5] ELSE v END AS label FROM x",
)
SQL["q_labels_unwrapped"] = SQL["q_labels_unwrapped"].replace("v LIKE '$_$!<%>!$$$_' ESCAPE '$' OR (starts_with(v, '_$!<') AND ends_with(v, '>!$_'))", "starts_with(v, '_$!<') AND ends_with(v, '>!$_')")
over(
    "q_printable", "documents", "doc_id, concat(coalesce(text, ''), CASE doc_id % 4 WHEN 0 THEN '\u202e' WHEN 1 THEN '\x7f' WHEN 2 THEN '\u2028' ELSE '' END) AS v",
    lambda t: t.select("doc_id", payloads.printable(F.col("v")).alias("shown")),
    r"SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(v, '(?s).'), lambda c: CASE WHEN regexp_matches(c, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]') THEN '<U+' || printf('%04X', unicode(c)) || '>' ELSE c END), ''), '') AS shown FROM x",
)
# Summaries of the other types: texts with runs of white space, paths of both systems, missing parts.
over(
    "q_summaries", "orders", "o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN concat(' ', o_orderpriority, '  ', o_orderstatus) END AS a, CASE WHEN o_orderkey % 3 <> 0 THEN concat('+1 ', cast(o_custkey AS string), repeat('9', o_orderkey % 50)) END AS b, CASE WHEN o_orderkey % 5 <> 0 THEN concat('/sd/', o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN '\\\\' ELSE '/' END, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE cast(o_orderkey AS string) END) END AS c, o_orderstatus AS d",
    lambda t: t.select(
        "o_orderkey", payloads.contact_summary(F.col("a"), F.col("b"), F.col("d")).alias("contact"), payloads.search_summary(F.col("a"), F.col("d")).alias("search"), payloads.download_summary(F.col("c"), F.col("a"), F.col("d")).alias("download"),
        payloads.calendar_summary(F.when(F.col("d") == "F", "series"), F.lit(None).cast("string"), F.col("a"), F.col("b"), F.when(F.col("d") == "O", "cancelled")).alias("event"),
    ),
    r"""SELECT o_orderkey, coalesce(nullif(concat_ws(' ', s, p32), ''), d) AS contact, coalesce(s, d) AS search, coalesce(nullif(regexp_extract(c, '([^/\\]*)$', 1), ''), s, d) AS download, concat_ws(' ', 'calendar', CASE WHEN d = 'F' THEN 'series' END, s, '@ ' || p64, CASE WHEN d = 'O' THEN '[cancelled]' END) AS event
FROM (SELECT *, trim(regexp_replace(a, '\s+', ' ', 'g')) AS s, CASE WHEN length(b) <= 32 THEN b ELSE b[:29] || '...' END AS p32, CASE WHEN length(b) <= 64 THEN b ELSE b[:61] || '...' END AS p64 FROM x)""",
)
SQL["q_summaries"] = SQL["q_summaries"].replace("'\\\\\\\\'", "'\\'")
DAY = "86400000"
over(
    "q_event_times", "orders", f"o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN unix_millis(cast(o_orderdate AS timestamp)) + CASE WHEN o_custkey % 6 = 0 THEN 3600000 ELSE 0 END END AS s, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN unix_millis(cast(o_orderdate AS timestamp)) + {DAY} WHEN 2 THEN unix_millis(cast(o_orderdate AS timestamp)) - 5 ELSE unix_millis(cast(o_orderdate AS timestamp)) + 7200000 END AS e, CASE o_custkey % 5 WHEN 0 THEN 'P1D' WHEN 1 THEN 'PT2H' WHEN 2 THEN 'later' END AS u, CASE WHEN o_orderkey % 10 = 9 THEN 5 ELSE o_orderkey % 2 END AS w, CASE WHEN o_custkey % 2 = 0 THEN 'UTC' ELSE 'Europe/Paris' END AS z",
    lambda t: t.select("o_orderkey", payloads.event_times(F.col("s"), F.col("e"), F.col("u"), F.col("w"), F.col("z")).alias("t")).select("o_orderkey", "t.*"),
    f"""SELECT o_orderkey, timing, CASE WHEN b THEN s * 1000 END AS start_us, CASE WHEN b AND w = 1 THEN strftime(make_timestamp(s * 1000), '%Y-%m-%d') END AS start_date, CASE WHEN ok THEN e2 * 1000 END AS end_us, CASE WHEN ok AND w = 1 THEN strftime(make_timestamp(e2 * 1000), '%Y-%m-%d') END AS end_date,
  CASE WHEN b THEN CASE WHEN w = 1 THEN 'local-unknown' ELSE 'utc' END END AS basis, CASE WHEN ok THEN CASE WHEN u IN ('P1D', 'PT2H') THEN 'duration' ELSE 'dtend' END END AS end_basis, CASE WHEN timing <> 'unknown' AND s IS NOT NULL AND NOT b THEN 'not-midnight' END AS state, end_state, b AND u IN ('P1D', 'PT2H') AND coalesce(e <> e2, false) AS conflict, CASE WHEN w = 1 AND z <> 'UTC' THEN 'not-utc' END AS zone_state
FROM (SELECT *, b AND end_state IS NULL AND coalesce(u <> 'later', true) AND e2 IS NOT NULL AS ok FROM (SELECT *, CASE WHEN timing = 'unknown' THEN NULL WHEN NOT b THEN 'no-start' WHEN u = 'later' THEN NULL WHEN e2 IS NULL THEN 'none-stored' WHEN e2 < s THEN 'end-before-start' WHEN w = 1 AND e2 % {DAY} <> 0 THEN 'not-midnight' END AS end_state
  FROM (SELECT *, CASE w WHEN 0 THEN 'timed' WHEN 1 THEN 'all_day' ELSE 'unknown' END AS timing, coalesce(w IN (0, 1) AND s IS NOT NULL AND (w = 0 OR s % {DAY} = 0), false) AS b, CASE u WHEN 'P1D' THEN s + {DAY} WHEN 'PT2H' THEN s + 7200000 ELSE e END AS e2 FROM x)))""",
)
SQL["q_event_times"] = SQL["q_event_times"].replace("unix_millis(cast(o_orderdate AS timestamp))", "epoch_ms(o_orderdate)")


def notes(spark: SparkSession, d: str) -> DataFrame:
    return R.records(spark, d).where("type = 'message'")


def index_states(spark: SparkSession, d: str) -> DataFrame:
    """State of an index before it is built, when one chunk of ids is missing, and after it was resumed, with the chunks written last."""
    path, recs, out = new_path(spark, "states"), notes(spark, d), []
    out.append(("before", search.index_state(recs, path), 0))
    every = sorted(r["chunk"] for r in search.missing_chunks(recs, path, 5000).collect())
    search.build_index(recs, path, 5000, every[:-1])
    out.append(("begun", search.index_state(recs, path), len(every) - 1))
    out.append(("resumed", search.index_state(recs, path), len(search.reindex(recs, path, 5000))))
    out[-1] = ("resumed", search.index_state(recs, path), out[-1][2])
    return spark.createDataFrame(out, "step string, state string, chunks bigint")


Q["q_index_states"] = index_states
SQL["q_index_states"] = RECORDS + r", c AS (SELECT count(DISTINCT (id - 1) // 5000) AS n FROM records WHERE type = 'message' AND (regexp_matches(coalesce(summary, ''), '[\p{L}\p{N}]') OR regexp_matches(coalesce(body, ''), '[\p{L}\p{N}]'))) SELECT 'before' AS step, 'unbuilt' AS state, 0 AS chunks UNION ALL SELECT 'begun', CASE WHEN n > 1 THEN 'building' ELSE 'building' END, n - 1 FROM c UNION ALL SELECT 'resumed', 'current', 1"


def resumed(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a list, by the cursors of the two before it."""
    f, recs = Filter(types=("message", "note")), R.records(spark, d)
    rows = recs.where(F.col("type").isin(*f.types))
    last = listing.page(rows, 40).collect()[-1]
    last = listing.resume(rows, f, listing.cursor(f, last["ts"], last["id"], False), 40).collect()[-1]
    return listing.resume(rows, f, listing.cursor(f, last["ts"], last["id"], False), 40).select("id", "ts")


Q["q_list_resumed"] = resumed
SQL["q_list_resumed"] = RECORDS + " SELECT id, ts FROM records WHERE type IN ('message', 'note') ORDER BY ts NULLS FIRST, id LIMIT 40 OFFSET 80"


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """Orders that come in three files, appended by micro-batch and read back: rows, ids and batches."""
    path = new_path(spark, "stream")
    rows = staged(spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS id", "o_custkey"), "orders")
    for n in range(3):
        rows.where(F.col("id") % 3 == n).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.ingest(stream, f"{path}/out", f"{path}/state").awaitTermination()
    ingest.ingest(stream, f"{path}/out", f"{path}/state").awaitTermination()  # nothing comes twice
    return ingest.batches(spark, f"{path}/out", ["id"]).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.count("*").alias("batches"))


Q["q_stream_ingest"] = streamed
SQL["q_stream_ingest"] = "SELECT count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, 3::BIGINT AS batches FROM orders"

# Calendars with the tables that only newer versions have.
APP |= {
    "CalendarAlerts": ("lineitem", "l_linenumber >= 4", "l_orderkey AS event_id, US(l_shipdate) // 1000 AS alarmTime"),
    "ExtendedProperties": ("lineitem", "l_linenumber = 1", "l_orderkey AS event_id, l_returnflag AS name, l_linestatus AS value"),
    "EventsRawTimes": ("orders", "o_orderkey % 3 <> 0", "o_orderkey AS event_id, concat(cast(o_custkey AS string), 'T') AS dtstart2445, o_orderpriority AS dtend2445"),
}
CALENDAR = (*registry.PARSERS["android.calendar"].needs, "CalendarAlerts", "ExtendedProperties", "EventsRawTimes")
Q["q_map_calendar_tables"] = lambda s, d: registry.PARSERS["android.calendar"].run({n: app_table(s, d, n) for n in CALENDAR}).select("rowid", "alerts", "next_alert", F.to_json("properties").alias("properties"), "raw_start", "raw_end", "raw_times_state")
SQL["q_map_calendar_tables"] = app_sql(CALENDAR) + """, a AS (SELECT event_id AS k, count(*) AS n, min(alarmTime) * 1000 AS t FROM a_CalendarAlerts GROUP BY 1), p AS (SELECT event_id AS k, '[' || string_agg(DISTINCT '{"name":"' || name || '","value":"' || value || '"}', ',' ORDER BY '{"name":"' || name || '","value":"' || value || '"}') || ']' AS j FROM a_ExtendedProperties GROUP BY 1)
SELECT _id AS rowid, coalesce(a.n, 0) AS alerts, a.t AS next_alert, p.j AS properties, r.dtstart2445 AS raw_start, r.dtend2445 AS raw_end, CASE WHEN r.event_id IS NULL THEN 'unresolved' ELSE 'found' END AS raw_times_state FROM a_Events e LEFT JOIN a ON a.k = _id LEFT JOIN p ON p.k = _id LEFT JOIN a_EventsRawTimes r ON r.event_id = _id"""


# Other tables that only some versions have.
APP |= {
    "op_raw_contacts": ("customer", "true", "c_custkey AS _id, c_name AS display_name, c_custkey % 4 // 3 AS deleted, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey END AS account_id"),
    "op_accounts": ("nation", "n_nationkey % 8 <> 3", "cast(n_nationkey AS bigint) AS _id, n_name AS account_name, concat('type', cast(n_regionkey AS string)) AS account_type"),
    "op_deleted_contacts": ("supplier", "true", "s_suppkey + 1000000 AS contact_id, s_suppkey * 1700000000 + 1600000000000 AS contact_deleted_timestamp"),
    "op_ABPerson": ("customer", "true", "c_custkey AS ROWID, c_name AS First, CASE WHEN c_custkey % 2 = 0 THEN 'X' END AS Last, c_custkey % 9 AS StoreID"),
    "op_ABMultiValue": ("orders", "true", "o_orderkey AS UID, o_custkey AS record_id, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 5 END AS property, o_orderkey % 4 AS label, CASE WHEN o_orderkey % 3 <> 2 THEN concat('v', cast(o_orderkey % 100 AS string)) END AS value"),
    "ABMultiValueEntry": ("lineitem", "l_orderkey % 3 = 2", "l_orderkey AS parent_id, l_linenumber AS key, concat('p', cast(l_suppkey AS string)) AS value"),
    "ABMultiValueEntryKey": ("region", "true", "cast(r_regionkey AS bigint) AS ROWID, r_name AS value"),
    "ABStore": ("region", "true", "cast(r_regionkey AS bigint) AS ROWID, r_name AS Name"),
    "ZWAMESSAGEINFO": ("lineitem", "true", "l_orderkey AS ZMESSAGE, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END AS ZRECEIPTINFO"),
}
CONTACTS = {"raw_contacts": "op_raw_contacts", "data": "data", "mimetypes": "mimetypes", "accounts": "op_accounts", "deleted_contacts": "op_deleted_contacts"}
Q["q_map_contacts_accounts"] = lambda s, d: registry.PARSERS["android.contacts"].run({n: app_table(s, d, a) for n, a in CONTACTS.items()}).select("rowid", "ts", "name", "deleted", "account", "account_type", "account_state")
SQL["q_map_contacts_accounts"] = app_sql(tuple(CONTACTS.values())) + f"""SELECT r._id AS rowid, NULL::BIGINT AS ts, display_name AS name, deleted = 1 AS deleted, account_name AS account, account_type, CASE WHEN account_id IS NULL THEN 'none' WHEN a._id IS NULL THEN 'unresolved' ELSE 'found' END AS account_state FROM a_op_raw_contacts r LEFT JOIN a_op_accounts a ON a._id = account_id
UNION ALL SELECT contact_id, {PLAUSIBLE.format(us="(contact_deleted_timestamp * 1000)")}, NULL, true, NULL, NULL, NULL FROM a_op_deleted_contacts"""
BOOK = {"ABPerson": "op_ABPerson", "ABMultiValue": "op_ABMultiValue", **{n: n for n in ("ABMultiValueLabel", "ABGroupMembers", "ABGroup", "ABMultiValueEntry", "ABMultiValueEntryKey", "ABStore")}}
Q["q_map_ios_addresses"] = lambda s, d: registry.PARSERS["ios.addressbook"].run({n: app_table(s, d, a) for n, a in BOOK.items()}).select("rowid", "phones", F.array_join("addresses", " | ").alias("addresses"), "store", "store_state")
SQL["q_map_ios_addresses"] = app_sql(tuple(BOOK.values())) + """, l AS (SELECT ROWID AS k, CASE WHEN value LIKE '%<%>%' THEN split_part(split_part(value, '<', 2), '>', 1) ELSE value END AS v FROM a_ABMultiValueLabel),
p AS (SELECT record_id AS k, array_to_string(list_sort(list(DISTINCT coalesce(l.v, '') || '=' || value) FILTER (WHERE property = 3)), ',') AS phones, count(*) AS n FROM a_op_ABMultiValue LEFT JOIN l ON l.k = label GROUP BY 1),
e AS (SELECT parent_id AS k, array_to_string(list_sort(list(DISTINCT CASE WHEN y.value IS NULL THEN x.value ELSE y.value || '=' || x.value END)), '; ') AS line FROM a_ABMultiValueEntry x LEFT JOIN a_ABMultiValueEntryKey y ON y.ROWID = x.key GROUP BY 1),
a AS (SELECT record_id AS k, array_to_string(list_sort(list(DISTINCT line)), ' | ') AS addresses FROM a_op_ABMultiValue JOIN e ON e.k = UID GROUP BY 1)
SELECT x.ROWID AS rowid, CASE WHEN p.n IS NOT NULL THEN coalesce(phones, '') END AS phones, addresses, s.Name AS store, CASE WHEN s.ROWID IS NULL THEN 'unresolved' ELSE 'found' END AS store_state FROM a_op_ABPerson x LEFT JOIN p ON p.k = x.ROWID LEFT JOIN a ON a.k = x.ROWID LEFT JOIN a_ABStore s ON s.ROWID = StoreID"""
RECEIPTS = (*registry.PARSERS["ios.whatsapp.chats"].needs, "ZWAMESSAGEINFO")
Q["q_map_ios_receipts"] = lambda s, d: registry.PARSERS["ios.whatsapp.chats"].run({n: app_table(s, d, n) for n in RECEIPTS}).select("rowid", "receipts")
SQL["q_map_ios_receipts"] = app_sql(RECEIPTS) + " SELECT Z_PK AS rowid, coalesce(n, 0) AS receipts FROM a_ZWAMESSAGE LEFT JOIN (SELECT ZMESSAGE AS k, count(ZRECEIPTINFO) AS n FROM a_ZWAMESSAGEINFO GROUP BY 1) ON k = Z_PK"
Q["q_map_ios_calls_legacy"] = lambda s, d: registry.PARSERS["ios.calls.legacy"].run({"call": app_table(s, d, "call")})
SQL["q_map_ios_calls_legacy"] = app_sql(("call",)) + " SELECT ROWID AS rowid, date * 1000000 AS ts, CASE WHEN duration >= 0 THEN (date + duration) * 1000000 END AS end_ts, 'unknown' AS direction, 'unknown' AS outcome, address, flags AS raw_flags FROM a_call"


# Owners of companions, the chain of namers, faults of an index by record, and postings from a stream.
Q["q_companion_owners"] = lambda s, d: reconcile.owners(s.read.parquet(f"{d}/lineitem.parquet").where("l_partkey % 11 <> 3 OR l_linenumber <> 1").selectExpr(*FILES.split(", ", 1)), "g", "path", F.col("path").rlike("^/db[0-9]+$"), {"wal": "-wal", "journal": "-journal"})
SQL["q_companion_owners"] = f"""WITH f AS (SELECT {FILES.replace('AS string', 'AS VARCHAR')} FROM lineitem WHERE l_partkey % 11 <> 3 OR l_linenumber <> 1), m AS (SELECT *, regexp_replace(path, '-(wal|journal)$', '') AS base, regexp_extract(path, '-(wal|journal)$', 1) AS role FROM f WHERE regexp_matches(path, '-(wal|journal)$')),
h AS (SELECT g, path, count(*) AS n FROM f WHERE regexp_full_match(path, '/db[0-9]+') GROUP BY 1, 2), k AS (SELECT g, base, role, count(*) AS k FROM m GROUP BY 1, 2, 3)
SELECT m.g, m.path, m.role, CASE WHEN h.n = 1 THEN m.base END AS owner, CASE WHEN h.n IS NULL THEN 'orphan' WHEN h.n > 1 THEN 'ambiguous' WHEN k.k > 1 THEN 'shared' ELSE 'ok' END AS state FROM m LEFT JOIN h ON h.g = m.g AND h.path = m.base JOIN k ON k.g = m.g AND k.base = m.base AND k.role = m.role"""
NAMED = "o_orderkey, concat(CASE o_orderkey % 3 WHEN 0 THEN '/data/data/com.android.providers.contacts/databases/' WHEN 1 THEN '/copies/' ELSE '/x' END, CASE o_custkey % 4 WHEN 0 THEN 'calllog.db' WHEN 1 THEN 'contacts2.db' WHEN 2 THEN 'sms.db' ELSE 'other.db' END) AS path, CASE o_custkey % 6 WHEN 0 THEN array('calls') WHEN 1 THEN array('ZCALLRECORD', 'more') WHEN 2 THEN array('message', 'handle') WHEN 3 THEN array('call', 'calls') ELSE array('wa_contacts') END AS tables"
over(
    "q_namer_chain", "orders", NAMED, lambda t: registry.named_by_chain(t, "path", "tables").select("o_orderkey", "parser", "namer"),
    """, y AS (SELECT *, CASE WHEN path LIKE '/data/data/com.android.providers.contacts/databases/calllog.db' THEN 'android.calllog' WHEN path LIKE '/data/data/com.android.providers.contacts/databases/contacts2.db' THEN 'android.contacts' END AS p,
  CASE split_part(path, '/', -1) WHEN 'calllog.db' THEN 'android.calllog' WHEN 'contacts2.db' THEN 'android.contacts' WHEN 'sms.db' THEN 'ios.sms' END AS n, CASE WHEN list_contains(tables, 'call') THEN NULL WHEN list_contains(tables, 'calls') THEN 'android.calllog' WHEN list_contains(tables, 'ZCALLRECORD') THEN 'ios.calls' WHEN list_contains(tables, 'wa_contacts') THEN 'android.whatsapp.contacts' END AS t FROM x)
SELECT o_orderkey, coalesce(p, n, t) AS parser, CASE WHEN p IS NOT NULL THEN 'path' WHEN n IS NOT NULL THEN 'name' WHEN t IS NOT NULL THEN 'tables' END AS namer FROM y""",
)
SQL["q_namer_chain"] = SQL["q_namer_chain"].replace("array(", "list_value(")


def index_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faults of an index from which records, words and places have been taken."""
    held = index(spark, d).where("id % 97 <> 3 AND NOT (id % 89 = 5 AND pos = 0)").withColumn("term", F.when((F.col("id") % 83 == 7) & (F.col("pos") == 1), "other").otherwise(F.col("term")))
    return search.index_faults(held, notes(spark, d))


Q["q_index_faults"] = index_faults
SQL["q_index_faults"] = POSTINGS + ", s AS (SELECT id, col, pos, CASE WHEN id % 83 = 7 AND pos = 1 THEN 'other' ELSE term END AS term FROM p WHERE id % 97 <> 3 AND NOT (id % 89 = 5 AND pos = 0)), e AS (SELECT id, list((col, pos, term) ORDER BY col, pos, term) AS v FROM p GROUP BY 1), g AS (SELECT id, list((col, pos, term) ORDER BY col, pos, term) AS v FROM s GROUP BY 1) SELECT id, CASE WHEN g.v IS NULL THEN 'missing' ELSE 'differs' END AS state FROM e LEFT JOIN g USING (id) WHERE e.v IS DISTINCT FROM g.v"


def streamed_postings(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "stream-postings")
    rows = staged(notes(spark, d).select("id", "summary", "body"), "notes")
    for n in range(2):
        rows.where(F.col("id") % 2 == n).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        postings.index_stream(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return postings.read(spark, f"{path}/out").groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("id").alias("records"))


Q["q_stream_postings"] = streamed_postings
SQL["q_stream_postings"] = POSTINGS + "SELECT term, count(*) AS n, count(DISTINCT id) AS records FROM p GROUP BY term"
