"""Registered queries of aliases, recovered rows, older schemas and run planning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import decoding
from tracelake.functions import values as V
from tracelake.mappings import recovery, registry
from tracelake.operators import carving, planning

from . import apps  # noqa: F401  (adds the app tables)
from .mapped import APP, app_sql, app_table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

APP |= {
    "al_jid": ("customer", "true", "c_custkey AS _id, CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN concat('l', cast(c_custkey AS string), '@lid') WHEN c_custkey % 5 = 1 THEN concat('l', cast(c_custkey % 100 AS string), '@lid') ELSE concat('u', cast(c_custkey AS string), '@s.example') END AS raw_string"),
    "al_jid_map": ("customer", "c_custkey % 5 IN (1, 3) AND c_custkey % 7 <> 0 OR c_custkey % 45 = 2", "c_custkey - c_custkey % 5 AS lid_row_id, c_custkey + c_custkey % 3 AS jid_row_id"),
    "al_message_system": ("orders", "o_orderkey % 8 = 3", "o_orderkey AS message_row_id, o_custkey % 90 AS action_type"),
    "al_message_vcard": ("lineitem", "l_linenumber = 6", "l_orderkey AS message_row_id"),
}

WHATSAPP = {n: f"wa_{n}" for n in registry.PARSERS["android.whatsapp.msgstore"].needs} | {n: f"al_{n}" for n in ("jid", "jid_map", "message_system", "message_vcard")}
LIDS = ("mapped", "unmapped", "unresolved", "ambiguous")


def aliases(spark: SparkSession, d: str) -> DataFrame:
    out = registry.records(registry.PARSERS["android.whatsapp.msgstore"], {n: app_table(spark, d, a) for n, a in WHATSAPP.items()})
    return out.select("rowid", *[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("chat", "sender", "system_action", "cards", "lid_map", *[f"lid_{s}" for s in LIDS[1:]])])


Q["q_whatsapp_aliases"] = aliases
_lids = lambda s: f"CASE WHEN count(*) FILTER (WHERE state = '{s}') > 0 THEN '[' || string_agg(DISTINCT '\"' || lid || '\"', ',' ORDER BY '\"' || lid || '\"') FILTER (WHERE state = '{s}') || ']' END AS lid_{s}"
SQL["q_whatsapp_aliases"] = app_sql(tuple(WHATSAPP.values())) + f""", j AS (SELECT raw_string, count(*) AS n, any_value(_id) AS id FROM a_al_jid WHERE raw_string LIKE '%@lid' GROUP BY 1), m AS (SELECT lid_row_id, count(*) AS n, any_value(jid_row_id) AS t FROM a_al_jid_map GROUP BY 1),
l AS (SELECT j.raw_string AS lid, CASE WHEN j.n > 1 THEN 'ambiguous' WHEN m.n IS NULL THEN 'unmapped' WHEN m.n > 1 THEN 'ambiguous' WHEN p.raw_string NOT LIKE '%@lid' THEN 'mapped' ELSE 'unresolved' END AS state, p.raw_string AS pn FROM j LEFT JOIN m ON m.lid_row_id = j.id LEFT JOIN a_al_jid p ON p._id = m.t),
x AS (SELECT x._id AS rowid, k.raw_string AS chat, q.raw_string AS sender FROM a_wa_message x LEFT JOIN a_wa_chat c ON c._id = x.chat_row_id LEFT JOIN a_al_jid k ON k._id = c.jid_row_id LEFT JOIN a_al_jid q ON q._id = x.sender_jid_row_id),
s AS (SELECT rowid, {_lids('unmapped')}, {_lids('unresolved')}, {_lids('ambiguous')}, CASE WHEN count(*) FILTER (WHERE state = 'mapped') > 0 THEN '[' || string_agg(DISTINCT '{{"lid":"' || lid || '","pn":"' || pn || '","source":"jid_map"}}', ',' ORDER BY '{{"lid":"' || lid || '","pn":"' || pn || '","source":"jid_map"}}') FILTER (WHERE state = 'mapped') || ']' END AS lid_map FROM x JOIN l ON l.lid IN (chat, sender) GROUP BY 1)
SELECT x.*, y.action_type::VARCHAR AS system_action, coalesce(v.n, 0)::VARCHAR AS cards, lid_map, lid_unmapped, lid_unresolved, lid_ambiguous FROM x LEFT JOIN s USING (rowid) LEFT JOIN a_al_message_system y ON y.message_row_id = x.rowid LEFT JOIN (SELECT message_row_id, count(*) AS n FROM a_al_message_vcard GROUP BY 1) v ON v.message_row_id = x.rowid"""

LEGACY = registry.PARSERS["android.whatsapp.msgstore.legacy"]
Q["q_map_whatsapp_legacy"] = lambda s, d: LEGACY.run({n: app_table(s, d, f"lg_{n}") for n in LEGACY.needs})
SQL["q_map_whatsapp_legacy"] = app_sql(tuple(f"lg_{n}" for n in LEGACY.needs)) + """, c AS (SELECT key_remote_jid AS k, count(*) AS n, any_value(subject) AS v FROM a_lg_chat_list GROUP BY 1)
SELECT x._id AS rowid, timestamp * 1000 AS ts, CASE key_from_me WHEN 1 THEN 'out' WHEN 0 THEN 'in' ELSE 'unknown' END AS direction, key_remote_jid AS chat, CASE WHEN n = 1 THEN v END AS subject, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS chat_state,
  CASE WHEN key_from_me = 0 THEN coalesce(nullif(remote_resource, ''), key_remote_jid) END AS sender, x.data AS body, q.data AS quotes, CASE WHEN quoted_row_id IS NULL THEN 'none' WHEN q._id IS NULL THEN 'unresolved' ELSE 'found' END AS quote_state, coalesce(status = 6, false) AS system
FROM a_lg_messages x LEFT JOIN c ON c.k = x.key_remote_jid LEFT JOIN a_lg_messages_quotes q ON q._id = x.quoted_row_id"""

# Visits recovered beside the live ones: without their transition, some with more unknown, of all methods, bases and relations.
FACTS = "CASE o_orderkey % 9 {} ELSE 'none' END".format(" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(V.METHODS)))
BASIS = "CASE o_custkey % 5 WHEN 0 THEN 'guess' WHEN 1 THEN 'fit' WHEN 2 THEN 'fit' ELSE 'schema' END"
RELATION = "CASE o_custkey % 7 WHEN 0 THEN 'live' WHEN 1 THEN 'unknown' WHEN 2 THEN 'superseded-version' ELSE 'absent-from-live' END"
RECOVERED = f"o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 1 THEN o_custkey END AS url, US(o_orderdate) + 11644473600000000 AS visit_time, {FACTS} AS _method, {BASIS} AS _basis, {RELATION} AS _relation, CASE WHEN o_orderkey % 33 = 0 THEN '' ELSE concat('page=', cast(o_orderkey AS string)) END AS _locator"
APP["rc_visits"] = ("orders", "o_orderkey % 5 = 0", RECOVERED)


def _recovered(spark: SparkSession, d: str) -> tuple:
    tables = {n: app_table(spark, d, n) for n in ("urls", "visits")}
    rows = app_table(spark, d, "rc_visits").withColumn("_unknown", F.when(F.col("url").isNull(), F.create_map(F.lit("url"), F.lit("unread"))))
    return registry.PARSERS["chromium.history"], tables, "visits", rows


def recovered_visits(spark: SparkSession, d: str) -> DataFrame:
    out = recovery.live_and_recovered(*_recovered(spark, d))
    return out.where(F.get_json_object("payload", "$.kind") == "visit").select("parser", "rowid", "ts", "method", "basis", "relation", "locator", "confidence", *[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("url", "url_state", "unknown_columns", "join_undecided")])


Q["q_recovered_visits"] = recovered_visits
REASON = "CASE WHEN _relation = 'live' THEN 'the row is live' WHEN _basis = 'guess' THEN 'basis is no schema and no fit' WHEN _method = 'none' THEN 'unknown method' WHEN _locator = '' THEN 'no locator' END"
BASE = "CASE _method " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in V.METHODS.items()) + " END"
SQL["q_recovered_visits"] = app_sql(("urls", "visits", "rc_visits")) + f""", r AS (SELECT *, {REASON} AS reason FROM a_rc_visits)
SELECT 'chromium.history' AS parser, x.id AS rowid, visit_time - 11644473600000000 AS ts, NULL AS method, NULL AS basis, NULL AS relation, NULL AS locator, NULL AS confidence, u.url, CASE WHEN u.id IS NULL THEN 'unresolved' ELSE 'found' END AS url_state, NULL AS unknown_columns, NULL AS join_undecided FROM a_visits x LEFT JOIN a_urls u ON u.id = x.url
UNION ALL SELECT 'chromium.history.recover', r.id, visit_time - 11644473600000000, _method, _basis, _relation, _locator, least({BASE}, CASE _basis WHEN 'fit' THEN 60 ELSE 100 END, CASE WHEN _relation = 'unknown' THEN 40 ELSE 100 END, 60),
  u.url, CASE WHEN r.url IS NULL THEN 'undecided' WHEN u.id IS NULL THEN 'unresolved' ELSE 'found' END, CASE WHEN r.url IS NULL THEN '{{"transition":"omitted","url":"unread"}}' ELSE '{{"transition":"omitted"}}' END, CASE WHEN r.url IS NULL THEN '["url"]' END FROM r LEFT JOIN a_urls u ON u.id = r.url WHERE reason IS NULL"""
Q["q_recovered_unmapped"] = lambda s, d: recovery.recovered(*_recovered(s, d))[1]
SQL["q_recovered_unmapped"] = app_sql(("rc_visits",)) + f" SELECT {REASON} AS reason, count(*) AS n FROM a_rc_visits GROUP BY 1 HAVING reason IS NOT NULL"

# Planning: files of databases and companions in acquisitions, of which some were parsed earlier.
TELEPHONY = "/data/data/com.android.providers.telephony/databases/mmssms.db"
CALLS = "/data/data/com.android.providers.contacts/databases/calllog.db"
FILES = f"o_orderkey AS artifact, o_custkey % 300 AS acquisition, CASE o_orderkey % 6 WHEN 0 THEN '{TELEPHONY}' WHEN 1 THEN '{TELEPHONY}-wal' WHEN 2 THEN '{CALLS}' WHEN 3 THEN '{CALLS}-journal' WHEN 4 THEN '/data/data/x/other.db' ELSE '{TELEPHONY}-journal' END AS path, concat('s', cast(o_custkey AS string)) AS sha256, o_orderkey % 50 = 0 AS encrypted"
RUN = "o_orderkey % 4 <> 1"


def files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT {FILES} FROM {{o}}", o=spark.read.parquet(f"{d}/orders.parquet"))


def _parser() -> F.Column:
    out = F.lit(None).cast("string")
    for pattern, name in registry.NAMERS.items():
        out = F.when(F.col("path").rlike(pattern), name).otherwise(out)
    return out


def planned(spark: SparkSession, d: str) -> DataFrame:
    """Jobs now, against runs over the files that were there then: all but a quarter, and under an older parser for some."""
    all_ = files(spark, d)
    then = planning.bundles(all_.where("artifact % 4 <> 1"), _parser())
    identity = {n: registry.parser_hash(p) for n, p in registry.PARSERS.items()}
    names = F.create_map(*[F.lit(x) for p in identity.items() for x in p])
    runs = then.select("parser", "digest", F.explode("members").alias("m")).select("parser", F.when(F.col("m.artifact") % 9 == 0, "older").otherwise(names[F.col("parser")]).alias("identity"), F.col("m.artifact").alias("artifact"), "digest", F.lit(1).alias("run"))
    return planning.jobs(planning.bundles(all_, _parser()), runs, identity)


Q["q_plan_jobs"] = planned
SQL["q_plan_jobs"] = f"""WITH f AS (SELECT {FILES.replace('string', 'VARCHAR')} FROM orders),
p AS (SELECT *, CASE path WHEN '{TELEPHONY}' THEN 'android.sms' WHEN '{CALLS}' THEN 'android.calllog' END AS parser FROM f WHERE path IN ('{TELEPHONY}', '{CALLS}')),
c AS (SELECT acquisition, path, count(*) AS n, min(artifact) AS artifact, min(sha256) AS sha256, bool_or(encrypted) AS encrypted FROM f GROUP BY 1, 2), d AS (SELECT acquisition, path, count(*) AS n, min(artifact) AS artifact, min(sha256) AS sha256 FROM f WHERE artifact % 4 <> 1 GROUP BY 1, 2),
b AS (SELECT p.*, sha256(concat_ws(chr(10), CASE WHEN j.n = 1 THEN 'journal=' || j.sha256 END, 'primary=' || p.sha256, CASE WHEN w.n = 1 THEN 'wal=' || w.sha256 END)) AS digest, concat_ws(', ', CASE WHEN j.n > 1 THEN 'journal' END, CASE WHEN w.n > 1 THEN 'wal' END) AS many,
      p.encrypted OR (coalesce(w.n, 0) = 1 AND w.encrypted) OR (coalesce(j.n, 0) = 1 AND j.encrypted) AS locked, [p.artifact, CASE WHEN w.n = 1 THEN w.artifact END, CASE WHEN j.n = 1 THEN j.artifact END] AS members
      FROM p LEFT JOIN c w ON w.acquisition = p.acquisition AND w.path = p.path || '-wal' LEFT JOIN c j ON j.acquisition = p.acquisition AND j.path = p.path || '-journal'),
r AS (SELECT p.parser, p.artifact AS of, sha256(concat_ws(chr(10), CASE WHEN j.n = 1 THEN 'journal=' || j.sha256 END, 'primary=' || p.sha256, CASE WHEN w.n = 1 THEN 'wal=' || w.sha256 END)) AS digest, [p.artifact, CASE WHEN w.n = 1 THEN w.artifact END, CASE WHEN j.n = 1 THEN j.artifact END] AS members
      FROM p LEFT JOIN d w ON w.acquisition = p.acquisition AND w.path = p.path || '-wal' LEFT JOIN d j ON j.acquisition = p.acquisition AND j.path = p.path || '-journal' WHERE p.artifact % 4 <> 1),
u AS (SELECT parser, m AS artifact, max(digest) AS digest, count(DISTINCT digest) AS k FROM (SELECT parser, digest, unnest(members) AS m FROM r) WHERE m IS NOT NULL AND m % 9 <> 0 GROUP BY 1, 2),
e AS (SELECT b.parser, b.artifact, b.path, b.digest, b.many, b.locked, m, u.digest AS last FROM (SELECT *, unnest(members) AS m FROM b) b LEFT JOIN u ON u.parser = b.parser AND u.artifact = m WHERE m IS NOT NULL),
g AS (SELECT parser, artifact, path, digest, many, locked, count(*) AS n, count(last) AS k, bool_or(last <> digest) AS changed, string_agg(m::VARCHAR, ', ' ORDER BY m) FILTER (WHERE last IS NULL) AS open FROM e GROUP BY ALL),
s AS (SELECT *, CASE WHEN locked OR many <> '' THEN 'unparsed' WHEN k = 0 THEN 'new' WHEN k = n AND NOT coalesce(changed, false) THEN 'already-parsed' ELSE 'stale-bundle' END AS status FROM g)
SELECT parser, artifact, path, digest, status, CASE WHEN many <> '' THEN 'ambiguous companion: ' || many WHEN locked THEN 'encrypted' WHEN status = 'stale-bundle' THEN coalesce('not covered by an earlier run: ' || open, 'another bundle than was parsed') END AS reason FROM s"""
Q["q_unclaimed_databases"] = lambda s, d: planning.unclaimed(files(s, d), _parser(), F.col("path").rlike(r"[.]db(-wal|-journal)?$"))
SQL["q_unclaimed_databases"] = f"WITH f AS (SELECT {FILES.replace('string', 'VARCHAR')} FROM orders) SELECT artifact, path FROM f WHERE path NOT IN ('{TELEPHONY}', '{CALLS}') AND NOT EXISTS (SELECT 1 FROM f g WHERE g.acquisition = f.acquisition AND g.path IN ('{TELEPHONY}', '{CALLS}') AND f.path IN (g.path || '-wal', g.path || '-journal'))"
TABLES = "l_orderkey AS artifact, CASE l_suppkey % 2 WHEN 0 THEN 'android' ELSE 'ios' END AS platform, CASE l_linenumber WHEN 1 THEN 'SMS' WHEN 2 THEN 'message' WHEN 3 THEN 'Messages' ELSE concat('t', cast(l_linenumber AS string)) END AS name"
Q["q_table_claims"] = lambda s, d: planning.claims(s.sql(f"SELECT {TABLES} FROM {{l}}", l=s.read.parquet(f"{d}/lineitem.parquet")), registry.claimed(s))
SQL["q_table_claims"] = f"WITH t AS (SELECT {TABLES.replace('string', 'VARCHAR')} FROM lineitem) SELECT artifact, name, CASE WHEN p IS NULL THEN 'unclaimed' WHEN contains(p, ',') THEN 'ambiguous' ELSE 'claimed' END AS state, p AS parsers FROM (SELECT *, CASE WHEN platform = 'android' THEN CASE name WHEN 'SMS' THEN 'android.sms' WHEN 'message' THEN 'android.whatsapp.msgstore' WHEN 'Messages' THEN 'android.telegram,android.whatsapp.msgstore.legacy' END ELSE CASE name WHEN 'message' THEN 'ios.sms' END END AS p FROM t)"

# Files of three kinds inside every document's bytes: one walked to its end, one with a footer, one cut off.
PNG = "89504E470D0A1A0A" + "0000000D49484452000000010000000108060000001F15C489" + "0000000A49444154789C63000100000500010D0A2DB4" + "0000000049454E44AE426082"
VALUE = "CASE doc_id % 3 WHEN 0 THEN concat({t}, unhex('" + PNG + "'), {t}) WHEN 1 THEN concat({t}, {pdf}, {t}, {eof}, {t}) ELSE concat({t}, substring(unhex('" + PNG + "'), 1, 60)) END"


def carved(spark: SparkSession, d: str) -> DataFrame:
    value = VALUE.format(t="encode(coalesce(text, ''), 'UTF-8')", pdf="encode('%PDF-1.4 ', 'UTF-8')", eof="encode('%%EOF', 'UTF-8')")
    return carving.carve(carving.chunked(spark.read.parquet(f"{d}/documents.parquet").withColumn("value", F.expr(value)), "doc_id", "value", 4096)).withColumnRenamed("key", "doc_id")


Q["q_carve_values"] = carved
SQL["q_carve_values"] = f"""WITH x AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'pdf' ELSE 'png' END AS name, n AS start, CASE doc_id % 3 WHEN 0 THEN {len(PNG) // 2} WHEN 1 THEN n + 14 ELSE 60 END AS length, CASE doc_id % 3 WHEN 0 THEN 'validated' WHEN 1 THEN 'footer' ELSE 'bounded' END AS outcome,
  CASE doc_id % 3 WHEN 0 THEN 70 WHEN 1 THEN 50 ELSE 25 END AS confidence, NULL::BIGINT AS inside FROM x WHERE doc_id % 3 <> 1 OR n >= 18"""

# Payloads of two versions, of one that nobody knows, and some that are no objects.
MESSAGES = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 9 ELSE CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END END AS version"
PAYLOAD = """CASE WHEN o_orderkey % 41 = 0 THEN '[1]' WHEN o_orderkey % 43 = 0 THEN 'broken' WHEN version = 2
  THEN concat('{"direction":"in","participants":[{"address":"c', cast(o_custkey AS string), '"}],"text":"', o_orderpriority, '","attachment_count":', cast(o_custkey % 4 AS string), ',"read":', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE '"maybe"' END, '}')
  ELSE concat('{"direction":"out","address":"c', cast(o_custkey AS string), '","body":"', o_orderpriority, '","attachments":"', CASE WHEN o_custkey % 10 = 0 THEN 'many' ELSE '3' END, '","more":"', o_orderstatus, '"}') END AS payload"""


def decoded_messages(spark: SparkSession, d: str) -> DataFrame:
    payload = PAYLOAD.replace("{", "{{").replace("}", "}}")
    rows = spark.sql(f"SELECT *, {payload} FROM (SELECT {MESSAGES} FROM {{o}})", o=spark.read.parquet(f"{d}/orders.parquet"))
    out = decoding.decoded(rows, "message")
    return out.select("o_orderkey", *decoding.FIELDS["message"], "state", F.array_join("undecoded", ",").alias("undecoded"), "rest")


Q["q_decoded_messages"] = decoded_messages
SQL["q_decoded_messages"] = f"""WITH m AS (SELECT *, {PAYLOAD.replace('string', 'VARCHAR')} FROM (SELECT {MESSAGES} FROM orders)),
p AS (SELECT *, CASE WHEN version NOT IN (1, 2) THEN 'unknown-version' WHEN NOT json_valid(payload) OR json_type(payload) <> 'OBJECT' THEN 'not-an-object' ELSE 'ok' END AS state, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM m),
f AS (SELECT *, CASE WHEN state = 'ok' THEN version END AS v FROM p)
SELECT o_orderkey, CASE WHEN v IS NOT NULL THEN j->>'$.direction' END AS direction, CASE v WHEN 1 THEN j->>'$.address' WHEN 2 THEN j->>'$.participants[0].address' END AS party, CASE v WHEN 1 THEN j->>'$.body' WHEN 2 THEN j->>'$.text' END AS body,
  CASE v WHEN 1 THEN TRY_CAST(j->>'$.attachments' AS BIGINT) WHEN 2 THEN TRY_CAST(j->>'$.attachment_count' AS BIGINT) END AS attachments, CASE v WHEN 2 THEN TRY_CAST(j->>'$.read' AS BOOLEAN) END AS read, state,
  CASE WHEN v = 1 THEN CASE WHEN TRY_CAST(j->>'$.attachments' AS BIGINT) IS NULL THEN 'attachments' ELSE '' END WHEN v = 2 THEN CASE WHEN TRY_CAST(j->>'$.read' AS BOOLEAN) IS NULL THEN 'read' ELSE '' END END AS undecoded, CASE WHEN v = 1 THEN '{{"more":"' || o_orderstatus || '"}}' END AS rest FROM f"""
