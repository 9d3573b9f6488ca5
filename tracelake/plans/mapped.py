"""Registered queries of the mappings, reconciliation and carving, over app tables that both engines derive from the driver's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import cells, texts
from tracelake.functions import values as V
from tracelake.mappings import registry
from tracelake.operators import carve, reconcile
from tracelake.sources import sink

#: App tables: the driver's table, its filter, and columns in SQL of both engines; US(c) is the microseconds of a time.
APP = {
    "urls": ("customer", "true", "c_custkey AS id, concat('https://h', cast(c_nationkey AS string), '.example/', cast(c_custkey AS string)) AS url, c_name AS title, (1700000000 + c_custkey + 11644473600) * 1000000 AS last_visit_time"),
    "visits": ("orders", "o_orderkey % 5 <> 0", "o_orderkey AS id, o_custkey + o_orderkey % 2 AS url, US(o_orderdate) + 11644473600000000 AS visit_time, o_orderkey % 12 + CASE WHEN o_orderkey % 2 = 0 THEN 536870912 ELSE 33554432 END AS transition"),
    "downloads": ("orders", "o_orderkey % 3 = 0", "o_orderkey AS id, US(o_orderdate) + 11644473600000000 AS start_time, o_orderkey % 6 AS state, concat('/sd/', cast(o_custkey AS string)) AS target_path"),
    "downloads_url_chains": ("lineitem", "l_partkey % 4 <> 0", "l_orderkey AS id, l_linenumber AS chain_index, concat('https://d.example/', cast(l_partkey AS string)) AS url"),
    "history_items": ("customer", "true", "c_custkey AS id, concat('https://i.example/', cast(c_custkey AS string)) AS url"),
    "history_visits": ("orders", "o_orderkey % 4 <> 0", "o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey * 2 END AS history_item, (US(o_orderdate) - 978307200000000) / 1000000 AS visit_time, o_orderpriority AS title"),
    "history_tombstones": ("part", "p_partkey % 3 = 0", "p_partkey AS id, 700000000 + p_partkey AS start_time, 700000000 + p_partkey * 2 AS end_time, p_name AS url"),
    "sms": ("events", "event_id % 2 = 0", "event_id AS _id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS thread_id, concat('+1555', cast(user_id AS string)) AS address, US(ts) // 1000 AS date, event_id % 8 AS type, props AS body"),
    "threads": ("customer", "c_custkey % 6 <> 0", "c_custkey AS _id, concat(cast(c_custkey % 40 AS string), ' ', cast(c_custkey % 13 AS string)) AS recipient_ids"),
    "canonical_addresses": ("supplier", "s_suppkey % 9 <> 1", "s_suppkey AS _id, concat('+1555', cast(s_suppkey AS string)) AS address"),
    "pdu": ("orders", "o_orderkey % 2 = 0", "o_orderkey AS _id, US(o_orderdate) // 1000000 AS date, o_orderkey % 5 AS msg_box"),
    "addr": ("lineitem", "true", "l_orderkey AS msg_id, concat('+1', cast(l_suppkey AS string)) AS address, CASE l_linenumber WHEN 1 THEN 137 WHEN 2 THEN 151 WHEN 3 THEN 151 WHEN 4 THEN 130 ELSE 129 END AS type"),
    "part": ("lineitem", "true", "l_orderkey AS mid, l_linenumber AS _id, l_partkey % 3 AS seq, CASE l_suppkey % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/smil' ELSE 'image/png' END AS ct, CASE WHEN l_partkey % 5 <> 0 THEN cast(l_partkey AS string) END AS text"),
    "calls": ("events", "event_id % 3 = 0", "event_id AS _id, concat('+1', cast(user_id AS string)) AS number, US(ts) // 1000 AS date, event_id % 4 AS duration, event_id // 3 % 9 AS type"),
    "raw_contacts": ("customer", "true", "c_custkey AS _id, c_name AS display_name, c_custkey % 4 // 3 AS deleted"),
    "data": ("orders", "true", "o_custkey AS raw_contact_id, o_orderkey % 7 AS mimetype_id, concat('v', cast(o_orderkey AS string)) AS data1"),
    "mimetypes": ("region", "true", "cast(r_regionkey AS bigint) AS _id, concat('vnd.example/', CASE r_regionkey WHEN 0 THEN 'phone_v2' WHEN 1 THEN 'email_v2' ELSE 'note' END) AS mimetype"),
    "Events": ("orders", "true", "o_orderkey AS _id, o_custkey % 30 AS calendar_id, US(o_orderdate) // 1000 AS dtstart, US(o_orderdate) // 1000 + 3600000 AS dtend, o_orderpriority AS title, o_orderkey % 2 AS deleted"),
    "Calendars": ("nation", "true", "cast(n_nationkey AS bigint) AS _id, n_name AS calendar_displayName"),
    "Attendees": ("lineitem", "l_linenumber > 2", "l_orderkey AS event_id, concat('s', cast(l_suppkey AS string), '@x.example') AS attendeeEmail, l_linenumber AS attendeeStatus"),
    "Reminders": ("lineitem", "l_linenumber <= 2", "l_orderkey AS event_id, l_suppkey % 3 * 10 AS minutes"),
    "message": ("events", "true", "event_id AS ROWID, CASE WHEN event_id % 9 <> 0 THEN user_id END AS handle_id, US(ts) // 1000000 - 978307200 AS date, event_id % 2 AS is_from_me"),
    "handle": ("supplier", "true", "s_suppkey AS ROWID, concat('+44', cast(s_suppkey AS string)) AS id"),
    "chat_message_join": ("events", "event_id % 3 <> 0", "user_id % 20 AS chat_id, event_id AS message_id"),
    "chat_handle_join": ("customer", "true", "c_custkey % 20 AS chat_id, c_custkey % 30 AS handle_id"),
    "message_attachment_join": ("lineitem", "true", "l_orderkey AS message_id, l_partkey AS attachment_id"),
    "chat_recoverable_message_join": ("orders", "o_orderkey % 10 = 0", "o_orderkey AS message_id"),
}

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def app_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    table, where, columns = APP[name]
    columns = re.sub(r"US\((\w+)\)", r"unix_micros(cast(\1 AS timestamp))", columns).replace(" // ", " div ")
    return spark.sql(f"SELECT {columns} FROM {{source}} WHERE {where}", source=spark.read.parquet(f"{d}/{table}.parquet"))


def app_sql(names: tuple[str, ...]) -> str:
    one = lambda n: f"\"a_{n}\" AS (SELECT {re.sub(r'US[(](.*?)[)]', r'epoch_us(\1)', APP[n][2])} FROM {APP[n][0]} WHERE {APP[n][1]})"
    return "WITH " + ", ".join(map(one, names))


def mapped(query: str, parser: str, sql: str, optional: tuple[str, ...] = ()) -> None:
    p = registry.PARSERS[parser]
    names = (*p.needs, *optional)

    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = {n: app_table(spark, d, n) for n in names}
        assert registry.probe(p, tables) == "applicable"
        return p.run(tables)

    Q[query], SQL[query] = run, app_sql(names) + sql


def look(table: str, key: str, value: str, alias: str) -> str:
    """A common table: key, how many rows, a value of the row."""
    return f', {alias} AS (SELECT "{key}" AS k, count(*) AS n, any_value({value}) AS v FROM "a_{table}" WHERE "{key}" IS NOT NULL GROUP BY 1)'


def case(value: str, names: dict[int, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in names.items()) + " ELSE 'unknown' END"


STATE = "CASE WHEN {k} IS NULL THEN 'none' WHEN {a}.n IS NULL THEN 'unresolved' WHEN {a}.n > 1 THEN 'ambiguous' ELSE 'found' END"
CORE = case("transition & 255", dict(enumerate(V.TRANSITIONS)))
mapped("q_map_chromium_visits", "chromium.history", f"""{look('urls', 'id', '{u: url, t: title}', 'u')}
SELECT 'visit' AS kind, id AS rowid, visit_time - 11644473600000000 AS ts, u.v.u AS url, u.v.t AS title, {STATE.format(k='x.url', a='u')} AS url_state, {CORE} AS core,
       CASE WHEN transition & 536870912 <> 0 THEN 'chain_end' ELSE 'from_address_bar' END AS qualifiers FROM a_visits x LEFT JOIN u ON u.k = x.url
UNION ALL SELECT 'url', id, last_visit_time - 11644473600000000, url, title, 'found', NULL, NULL FROM a_urls y WHERE NOT EXISTS (SELECT 1 FROM a_visits z WHERE z.url = y.id)""")
mapped("q_map_chromium_downloads", "chromium.downloads", """, c AS (SELECT id AS k, arg_min(url, (chain_index, url)) AS a, arg_max(url, (chain_index, url)) AS b, count(*) AS n FROM a_downloads_url_chains GROUP BY 1)
SELECT id AS rowid, start_time - 11644473600000000 AS ts, CASE state WHEN 0 THEN 'in_progress' WHEN 1 THEN 'complete' WHEN 2 THEN 'cancelled' WHEN 5 THEN 'unknown' ELSE 'interrupted' END AS state, state AS raw_state,
       target_path, a AS first_url, b AS last_url, coalesce(n, 0) AS hops FROM a_downloads LEFT JOIN c ON k = id""")
mapped("q_map_safari_history", "safari.history", f"""{look('history_items', 'id', 'url', 'u')}
SELECT 'visit' AS kind, id AS rowid, (visit_time * 1000000)::BIGINT + 978307200000000 AS ts, NULL::BIGINT AS end_ts, u.v AS url, title, {STATE.format(k='history_item', a='u')} AS item_state, false AS deleted FROM a_history_visits LEFT JOIN u ON k = history_item
UNION ALL SELECT 'item', id, NULL, NULL, url, NULL, 'found', false FROM a_history_items i WHERE NOT EXISTS (SELECT 1 FROM a_history_visits v WHERE v.history_item = i.id)
UNION ALL SELECT 'tombstone', id, start_time * 1000000 + 978307200000000, end_time * 1000000 + 978307200000000, url, NULL, NULL, true FROM a_history_tombstones""", ("history_tombstones",))
mapped("q_map_sms", "android.sms", f"""{look('canonical_addresses', '_id', 'address', 'u')}
, i AS (SELECT _id AS t, unnest(string_split(recipient_ids, ' '))::BIGINT AS r FROM a_threads), m AS (SELECT t, array_to_string(list_sort(coalesce(list(DISTINCT u.v) FILTER (WHERE u.n = 1), [])), ',') AS members, count(*) FILTER (WHERE u.n IS DISTINCT FROM 1) AS bad FROM i LEFT JOIN u ON k = r GROUP BY t)
SELECT _id AS rowid, date * 1000 AS ts, {case('type', V.SMS_DIRECTIONS)} AS direction, type AS raw_type, address, members, CASE WHEN thread_id IS NULL THEN 'none' WHEN t IS NULL THEN 'unresolved' WHEN bad > 0 THEN 'partial' ELSE 'found' END AS thread_state, body FROM a_sms LEFT JOIN m ON t = thread_id""")
mapped("q_map_mms", "android.mms", """, p AS (SELECT msg_id AS k, array_to_string(list_sort(coalesce(list(DISTINCT address) FILTER (WHERE type = 137), [])), ',') AS sender, array_to_string(list_sort(coalesce(list(DISTINCT address) FILTER (WHERE type = 151), [])), ',') AS receivers,
  array_to_string(list_sort(coalesce(list(DISTINCT address) FILTER (WHERE type = 130), [])), ',') AS copies FROM a_addr GROUP BY 1),
b AS (SELECT mid, coalesce(string_agg(text, chr(10) ORDER BY seq, _id, text) FILTER (WHERE ct = 'text/plain'), '') AS body, count(*) FILTER (WHERE ct = 'image/png') AS n FROM a_part GROUP BY 1)
SELECT _id AS rowid, date * 1000000 AS ts, CASE msg_box WHEN 1 THEN 'in' WHEN 3 THEN 'draft' WHEN 0 THEN 'unknown' ELSE 'out' END AS direction, msg_box AS raw_box, sender, receivers, copies, body, coalesce(n, 0) AS attachments FROM a_pdu LEFT JOIN p ON k = _id LEFT JOIN b ON mid = _id""")
mapped("q_map_calls", "android.calllog", f""" SELECT _id AS rowid, date * 1000 AS ts, date * 1000 + duration * 1000000 AS end_ts, CASE WHEN type = 2 THEN 'out' WHEN type BETWEEN 1 AND 7 THEN 'in' ELSE 'unknown' END AS direction,
  CASE WHEN type = 2 AND duration = 0 THEN 'cancelled' ELSE {case('type', V.CALL_OUTCOMES)} END AS outcome, type AS raw_type, number FROM a_calls""")
mapped("q_map_contacts", "android.contacts", """, h AS (SELECT raw_contact_id AS k, array_to_string(list_sort(coalesce(list(DISTINCT data1) FILTER (WHERE mimetype LIKE '%/phone_v2'), [])), ',') AS phones,
  array_to_string(list_sort(coalesce(list(DISTINCT data1) FILTER (WHERE mimetype LIKE '%/email_v2'), [])), ',') AS emails, count(*) FILTER (WHERE mimetype IS NULL) AS unknown FROM a_data LEFT JOIN a_mimetypes ON mimetype_id = _id GROUP BY 1)
SELECT _id AS rowid, NULL::BIGINT AS ts, display_name AS name, deleted = 1 AS deleted, phones, emails, coalesce(unknown, 0) AS unknown FROM a_raw_contacts LEFT JOIN h ON k = _id""")
mapped("q_map_calendar", "android.calendar", """, g AS (SELECT event_id AS k, array_to_string(list_sort(list(DISTINCT attendeeEmail || '=' || CASE attendeeStatus WHEN 3 THEN 'invited' WHEN 4 THEN 'tentative' ELSE 'unknown' END)), ',') AS attendees FROM a_Attendees GROUP BY 1),
r AS (SELECT event_id AS k, array_to_string(list_sort(list(DISTINCT minutes)), ',') AS reminders FROM a_Reminders GROUP BY 1)
SELECT e._id AS rowid, dtstart * 1000 AS ts, dtend * 1000 AS end_ts, title, calendar_displayName AS calendar, CASE WHEN c._id IS NULL THEN 'unresolved' ELSE 'found' END AS calendar_state, deleted = 1 AS deleted, attendees, reminders
FROM a_Events e LEFT JOIN a_Calendars c ON c._id = calendar_id LEFT JOIN g ON g.k = e._id LEFT JOIN r ON r.k = e._id""")
mapped("q_map_ios_messages", "ios.sms", """, p AS (SELECT j.chat_id AS c, array_to_string(list_sort(coalesce(list(DISTINCT h.id) FILTER (WHERE h.id IS NOT NULL), [])), ',') AS members FROM a_chat_handle_join j LEFT JOIN a_handle h ON h.ROWID = j.handle_id GROUP BY 1),
m AS (SELECT message_id AS k, arg_min(members, chat_id) AS members, count(DISTINCT chat_id) AS chats FROM a_chat_message_join JOIN p ON c = chat_id GROUP BY 1), f AS (SELECT message_id AS k, count(DISTINCT attachment_id) AS n FROM a_message_attachment_join GROUP BY 1)
SELECT x.ROWID AS rowid, (date + 978307200) * 1000000 AS ts, CASE is_from_me WHEN 1 THEN 'out' ELSE 'in' END AS direction, h.id AS address, CASE WHEN handle_id IS NULL THEN 'none' WHEN h.id IS NULL THEN 'unresolved' ELSE 'found' END AS handle_state, members, coalesce(chats, 0) AS chats, coalesce(n, 0) AS attachments,
  x.ROWID IN (SELECT message_id FROM a_chat_recoverable_message_join) AS deleted FROM a_message x LEFT JOIN a_handle h ON h.ROWID = handle_id LEFT JOIN m ON m.k = x.ROWID LEFT JOIN f ON f.k = x.ROWID""", ("chat_handle_join", "message_attachment_join", "chat_recoverable_message_join"))  # fmt: skip

# Reconciliation.
read = lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet")
Q["q_reconcile"] = lambda s, d: reconcile.reconcile(read(s, d, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "o_orderkey % 4 AS h"), read(s, d, "lineitem").where("l_linenumber <= 2 AND l_partkey % 2 = 0").selectExpr("l_orderkey AS k", "l_partkey % 4 AS h"), "k", "h")
SQL["q_reconcile"] = """WITH a AS (SELECT o_orderkey AS k, count(*) AS n, min(o_orderkey % 4) AS h FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n, min(l_partkey % 4) AS h FROM lineitem WHERE l_linenumber <= 2 AND l_partkey % 2 = 0 GROUP BY 1)
SELECT k, CASE WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'unnamed' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'bound' ELSE 'differs' END AS state FROM a FULL JOIN b USING (k)"""
FILES = "l_suppkey AS g, concat('/db', cast(l_partkey % 50 AS string), CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '-wal' WHEN 3 THEN '-journal' ELSE '.tmp' END) AS path"
Q["q_bundle_roles"] = lambda s, d: reconcile.roles(read(s, d, "lineitem").selectExpr(*FILES.split(", ", 1)), "g", "path", F.col("path").rlike("^/db[0-9]+$"), {"wal": "-wal", "journal": "-journal"})
SQL["q_bundle_roles"] = f"WITH f AS (SELECT {FILES} FROM lineitem), c AS (SELECT g, path, count(*) AS n FROM f GROUP BY 1, 2) SELECT f.g, f.path, " + ", ".join(f"CASE WHEN {x}.n IS NULL THEN 'missing' WHEN {x}.n > 1 THEN 'ambiguous' ELSE 'ok' END AS {x}" for x in ("wal", "journal")) + " FROM f LEFT JOIN c wal ON wal.g = f.g AND wal.path = f.path || '-wal' LEFT JOIN c journal ON journal.g = f.g AND journal.path = f.path || '-journal' WHERE regexp_matches(f.path, '^/db[0-9]+$')"
Q["q_last_state"] = lambda s, d: reconcile.last_state(read(s, d, "events"), "user_id", ["ts", "event_id"], "event_type")
SQL["q_last_state"] = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS entries FROM events GROUP BY 1"
Q["q_job_lifecycle"] = lambda s, d: reconcile.jobs(read(s, d, "events").selectExpr("user_id", "event_id", "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' END AS kind").where("kind IS NOT NULL"), "user_id", ["event_id"], "kind")
SQL["q_job_lifecycle"] = """WITH j AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' END AS kind FROM events WHERE event_type IN ('signup', 'purchase')), w AS (SELECT *, lead(kind) OVER o AS nx, lag(kind) OVER o AS bf FROM j WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, kind, CASE WHEN kind = 'end' THEN 'unstarted' WHEN nx = 'end' THEN 'finished' WHEN nx = 'start' THEN 'restarted' ELSE 'open' END AS state FROM w WHERE kind = 'start' OR bf IS DISTINCT FROM 'start'"""
Q["q_ranges_outside"] = lambda s, d: reconcile.outside(read(s, d, "lineitem").selectExpr("l_partkey AS k", "l_orderkey AS offset", "l_suppkey AS length"), read(s, d, "part").where("p_partkey % 7 <> 0").selectExpr("p_partkey AS k", "p_size * 400L AS size"), "k")
SQL["q_ranges_outside"] = "SELECT l_partkey AS k, l_orderkey AS offset, l_suppkey AS length FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) ON p_partkey = l_partkey WHERE p_size IS NULL OR l_orderkey + l_suppkey > p_size * 400"
TAGS = (carve.Signature("script", b"<script", b"</script>"), carve.Signature("style", b"<style", b"</style>"))
Q["q_carve_signatures"] = lambda s, d: carve.carve(read(s, d, "pages").select("page_id", "html"), "page_id", "html", TAGS).groupBy("page_id", "signature").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.sum("size").alias("bytes"))
SQL["q_carve_signatures"] = "WITH f AS (" + " UNION ALL ".join(f"SELECT page_id, '{t}' AS signature, strlen(string_split(html, '<{t}')[1])::BIGINT AS first_start, unnest(string_split(html, '<{t}')[2:]) AS x FROM pages" for t in ("script", "style")) + ") SELECT page_id, signature, count(*) AS n, min(first_start) AS first_start, sum(strlen(string_split(x, '</' || signature || '>')[1]) + length(signature) + 1 + length(signature) + 3)::BIGINT AS bytes FROM f WHERE contains(x, '</' || signature || '>') GROUP BY 1, 2"

# Cells, texts, scans and the census.
Q["q_typed_order"] = lambda s, d: (
    read(s, d, "lineitem").where("l_linenumber <= 4").select("l_linenumber", cells.cell(F.when(F.col("l_linenumber") == 1, F.col("l_partkey")), F.when(F.col("l_linenumber") == 2, F.col("l_extendedprice")), F.when(F.col("l_linenumber") == 3, F.col("l_shipdate").cast("string"))).alias("c"))
    .groupBy("l_linenumber").agg(F.min(cells.order_key(F.col("c"))).alias("lo"), F.max(cells.order_key(F.col("c"))).alias("hi")).select(F.col("l_linenumber").cast("bigint").alias("line"), F.col("lo.kind").cast("bigint").alias("kind"), F.col("lo.near").alias("least"), F.col("hi.near").alias("most"), F.decode("hi.t", "UTF-8").alias("last_text"))
)
SQL["q_typed_order"] = "SELECT l_linenumber::BIGINT AS line, [1, 1, 2, 0][l_linenumber]::BIGINT AS kind, CASE l_linenumber WHEN 1 THEN min(l_partkey)::DOUBLE WHEN 2 THEN min(l_extendedprice) END AS least, CASE l_linenumber WHEN 1 THEN max(l_partkey)::DOUBLE WHEN 2 THEN max(l_extendedprice) END AS most, CASE l_linenumber WHEN 3 THEN max(l_shipdate::VARCHAR) END AS last_text FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_linenumber"
Q["q_typed_equality"] = lambda s, d: (
    read(s, d, "lineitem").select(cells.equality_key(cells.cell(r=F.col("l_quantity"))).alias("key")).join(read(s, d, "part").select("p_partkey", cells.equality_key(cells.cell(i=F.col("p_size"))).alias("key")).groupBy("key").agg(F.count("*").alias("parts")), "key").groupBy("parts").agg(F.count("*").alias("n"))
)
SQL["q_typed_equality"] = "SELECT parts, count(*) AS n FROM lineitem JOIN (SELECT p_size, count(*) AS parts FROM part GROUP BY 1) ON l_quantity = p_size GROUP BY parts"
Q["q_compare_affinity"] = lambda s, d: read(s, d, "part").select("p_partkey", F.expr("concat(cast(p_partkey AS string), CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.50' WHEN 2 THEN 'x' ELSE '0000000000000000000' END)").alias("t")).select("p_partkey", cells.as_number(F.col("t")).alias("x")).select("p_partkey", "x.*")
SQL["q_compare_affinity"] = "SELECT p_partkey, ['exact', 'exact', 'text', 'undecided'][p_partkey % 4 + 1] AS state, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS i, CASE WHEN p_partkey % 4 = 1 THEN p_partkey + 0.5::DOUBLE END AS r FROM part"
Q["q_durations"] = lambda s, d: read(s, d, "orders").select("o_orderkey", texts.duration_seconds(F.expr("concat('P', cast(o_custkey AS string), CASE o_orderkey % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'D' WHEN 2 THEN 'DT2H' WHEN 3 THEN 'Q' ELSE '0000000W' END)")).alias("x")).select("o_orderkey", "x.*")
SQL["q_durations"] = "SELECT o_orderkey, CASE WHEN state = 'ok' AND seconds > 2147483647 THEN 'out-of-range' ELSE state END AS state, CASE WHEN state = 'ok' AND seconds <= 2147483647 THEN seconds END AS seconds FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN 'unparsed' WHEN o_orderkey % 5 = 4 AND o_custkey >= 100 THEN 'too-long' ELSE 'ok' END AS state, CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 86400 WHEN 2 THEN o_custkey * 86400 + 7200 WHEN 4 THEN o_custkey * 10000000 * 604800 END AS seconds FROM orders)"
Q["q_summary"] = lambda s, d: read(s, d, "conversations").select("conv_id", "turn", texts.summary(F.col("text"), 60).alias("summary"))
SQL["q_summary"] = r"SELECT conv_id, turn, CASE WHEN length(x) <= 60 THEN x ELSE substr(x, 1, 57) || '...' END AS summary FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[\p{Z}\p{Cc}]+', ' ', 'g')) AS x FROM conversations)"
Q["q_times_filetime"] = lambda s, d: read(s, d, "orders").select("o_orderkey", texts.filetime_us(F.expr("(unix_micros(cast(o_orderdate AS timestamp)) + 11644473600000000) * 10 + o_orderkey % 10")).alias("us"), texts.guarded_ms_us(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN unix_seconds(cast(o_orderdate AS timestamp)) ELSE unix_millis(cast(o_orderdate AS timestamp)) END")).alias("guarded"))
SQL["q_times_filetime"] = "SELECT o_orderkey, epoch_us(o_orderdate) AS us, CASE WHEN o_orderkey % 2 = 1 THEN epoch_us(o_orderdate) END AS guarded FROM orders"
Q["q_census"] = lambda s, d: sink.census(read(s, d, "lineitem"), {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "free": F.col("l_discount") == 0})
SQL["q_census"] = "SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_discount = 0) AS free FROM lineitem"
Q["q_order_violations"] = lambda s, d: sink.order_violations(read(s, d, "events").selectExpr("user_id", "event_id", "CASE WHEN event_id % 50 <> 0 THEN cast(value AS bigint) END AS v"), "user_id", "event_id", "v")
SQL["q_order_violations"] = "SELECT user_id, event_id, v, CASE WHEN b IS NULL OR v IS NULL THEN 'undecided' WHEN b = v THEN 'equal' ELSE 'descends' END AS state FROM (SELECT *, lag(v) OVER w AS b, row_number() OVER w AS i FROM (SELECT user_id, event_id, CASE WHEN event_id % 50 <> 0 THEN trunc(value)::BIGINT END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE i > 1 AND (b IS NULL OR v IS NULL OR b >= v)"
Q["q_unresolved_batches"] = lambda s, d: sink.unresolved(read(s, d, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS batch"), read(s, d, "lineitem").selectExpr("l_orderkey AS batch").distinct(), ["batch"])
SQL["q_unresolved_batches"] = "SELECT o_orderkey AS batch, 'not stored' AS state FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'not audited' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)"
