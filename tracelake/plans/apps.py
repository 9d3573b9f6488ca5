"""Registered queries of further mappings: iOS calls, contacts and calendars, chat apps, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.mappings import chats, registry

from .mapped import APP, STATE, app_sql, app_table, case, look, mapped

SECONDS = "US({}) // 1000000 - 978307200"
JID = "concat('u', cast(c_custkey AS string), '@s.example')"
APP |= {
    "keyword_search_terms": ("orders", "o_orderkey % 4 = 0", "o_orderkey AS keyword_id, o_custkey AS url_id, o_orderpriority AS term"),
    "ZCALLRECORD": ("orders", "true", f"o_orderkey AS Z_PK, {SECONDS.format('o_orderdate')} AS ZDATE, o_custkey % 600 AS ZDURATION, o_orderkey % 3 AS ZORIGINATED, o_custkey % 2 AS ZANSWERED, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 5 END AS ZCALLTYPE, concat('+1', cast(o_custkey AS string)) AS ZADDRESS"),
    "ABPerson": ("customer", "true", "c_custkey AS ROWID, c_name AS First, CASE WHEN c_custkey % 2 = 0 THEN 'X' END AS Last"),
    "ABMultiValue": ("orders", "true", "o_custkey AS record_id, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 9 END AS property, o_orderkey % 4 AS label, concat('v', cast(o_orderkey % 100 AS string)) AS value"),
    "ABMultiValueLabel": ("region", "r_regionkey <= 2", "r_regionkey AS ROWID, concat('_$!<L', cast(r_regionkey AS string), '>!$_') AS value"),
    "ABGroupMembers": ("lineitem", "true", "l_suppkey % 7 AS group_id, l_partkey AS member_id"),
    "ABGroup": ("region", "true", "r_regionkey AS ROWID, r_name AS Name"),
    "CalendarItem": ("orders", "true", f"o_orderkey AS ROWID, o_orderpriority AS summary, {SECONDS.format('o_orderdate')} AS start_date, {SECONDS.format('o_orderdate')} + 3600 AS end_date, o_orderkey % 2 AS all_day, o_custkey % 30 AS calendar_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 10 END AS location_id"),
    "Calendar": ("nation", "true", "n_nationkey AS ROWID, n_name AS title"),
    "Location": ("region", "true", "r_regionkey AS ROWID, r_name AS title"),
    "Participant": ("lineitem", "true", "l_orderkey AS owner_id, l_suppkey % 30 AS identity_id"),
    "Identity": ("nation", "true", "n_nationkey AS ROWID, n_name AS display_name"),
    "Alarm": ("lineitem", "l_linenumber <= 2", "l_orderkey AS calendaritem_owner_id, l_linenumber * -15 AS trigger_interval"),
    "Recurrence": ("orders", "o_orderkey % 5 = 0", "o_orderkey AS owner_id, o_custkey % 4 AS frequency"),
    "ExceptionDate": ("lineitem", "l_linenumber = 3", "l_orderkey AS owner_id, l_partkey AS date"),
    "wa_jid": ("customer", "true", f"c_custkey AS _id, {JID} AS raw_string"),
    "wa_chat": ("supplier", "true", "s_suppkey AS _id, s_suppkey * 3 AS jid_row_id, s_name AS subject"),
    "wa_message": ("orders", "true", "o_orderkey AS _id, o_custkey % 150 AS chat_row_id, o_orderkey % 2 AS from_me, US(o_orderdate) // 1000 AS timestamp, o_orderpriority AS text_data, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS sender_jid_row_id, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS starred"),
    "wa_message_media": ("lineitem", "l_linenumber <= 2", "l_orderkey AS message_row_id, concat('/m/', cast(l_partkey AS string)) AS file_path"),
    "wa_message_quoted": ("lineitem", "l_linenumber = 3", "l_orderkey AS message_row_id, concat('k', cast(l_suppkey AS string)) AS key_id"),
    "wa_message_revoked": ("orders", "o_orderkey % 9 = 0", "o_orderkey AS message_row_id"),
    "wa_message_add_on": ("lineitem", "l_linenumber >= 5", "l_orderkey AS parent_message_row_id, l_returnflag AS reaction"),
    "wa_deleted_chat_job": ("customer", "true", "c_custkey AS _id, c_custkey % 60 AS chat_row_id, c_custkey * 2 AS deleted_message_row_id, c_custkey AS deleted_starred_message_row_id"),
    "wa_call_log": ("events", "true", "event_id AS _id, user_id AS jid_row_id, event_id % 2 AS from_me, US(ts) // 1000 AS timestamp, event_id % 600 AS duration, event_id % 7 AS call_result, event_id % 2 AS video_call"),
    "wa_call_log_participant_v2": ("lineitem", "true", "l_orderkey AS call_log_row_id, l_suppkey AS jid_row_id"),
    "wa_contacts": ("customer", "true", "c_custkey AS _id, concat('u', cast(c_custkey AS string), CASE WHEN c_custkey % 3 = 0 THEN ':7' ELSE '' END, '@s.example') AS jid, c_mktsegment AS number, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS display_name, c_mktsegment AS wa_name, c_custkey % 2 AS is_whatsapp_user"),
    "ZWAMESSAGE": ("orders", "true", f"o_orderkey AS Z_PK, o_custkey % 120 AS ZCHATSESSION, o_orderkey % 2 AS ZISFROMME, {SECONDS.format('o_orderdate')} AS ZMESSAGEDATE, o_orderpriority AS ZTEXT, o_custkey % 40 AS ZGROUPMEMBER, o_custkey % 3 AS ZMEDIAITEM"),
    "ZWACHATSESSION": ("supplier", "true", "s_suppkey AS Z_PK, concat('c', cast(s_suppkey AS string)) AS ZCONTACTJID, s_name AS ZPARTNERNAME"),
    "ZWAGROUPMEMBER": ("nation", "true", "n_nationkey AS Z_PK, n_name AS ZMEMBERJID"),
    "ZWAMEDIAITEM": ("region", "true", "r_regionkey AS Z_PK, concat('/media/', r_name) AS ZMEDIALOCALPATH"),
    "ZWACDCALLEVENT": ("events", "true", f"event_id AS Z_PK, {SECONDS.format('ts')} AS ZDATE, event_id % 500 AS ZDURATION, event_id % 5 AS ZOUTCOME, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id - event_id % 3 END AS Z1CALLEVENTS"),
    "ZWAAGGREGATECALLEVENT": ("orders", "true", "o_orderkey AS Z_PK, o_orderkey % 2 AS ZINCOMING, o_custkey % 2 AS ZVIDEO"),
    "ZWAADDRESSBOOKCONTACT": ("customer", "true", f"c_custkey AS Z_PK, {JID} AS ZWHATSAPPID, c_name AS ZFULLNAME, c_mktsegment AS ZPHONENUMBER"),
    "messages": ("orders", "true", "o_orderkey AS mid, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN -(o_custkey % 40) - 1 ELSE (o_custkey % 200 + 1) * 4294967296 END AS uid, o_orderkey % 2 AS out, US(o_orderdate) // 1000000 AS date, o_orderpriority AS message"),
    "users": ("customer", "c_custkey % 7 <> 0", "c_custkey AS uid, c_name AS name, c_mktsegment AS phone"),
    "chats": ("nation", "true", "n_nationkey AS uid, n_name AS name"),
    "enc_chats": ("supplier", "true", "s_suppkey AS uid, s_suppkey * 2 AS user"),
    "contacts": ("supplier", "true", "s_suppkey * 3 AS uid, s_suppkey % 2 AS mutual"),
    "call": ("events", "event_id % 2 = 1", "event_id AS ROWID, concat('+2', cast(user_id AS string)) AS address, US(ts) // 1000000 AS date, event_id % 300 - 1 AS duration, event_id % 6 AS flags"),
    "lg_messages": ("orders", "true", "o_orderkey AS _id, concat('c', cast(o_custkey % 150 AS string)) AS key_remote_jid, o_orderkey % 3 AS key_from_me, US(o_orderdate) // 1000 AS timestamp, o_orderpriority AS data, o_custkey % 7 AS status, CASE WHEN o_orderkey % 4 = 0 THEN concat('r', cast(o_custkey AS string)) ELSE '' END AS remote_resource, CASE WHEN o_orderkey % 6 = 1 THEN o_custkey END AS quoted_row_id"),
    "lg_chat_list": ("supplier", "true", "concat('c', cast(s_suppkey % 90 AS string)) AS key_remote_jid, s_name AS subject"),
    "lg_messages_quotes": ("part", "p_partkey % 3 <> 0", "p_partkey AS _id, p_name AS data"),
}
#: Parsers whose tables have names that others use too: their app tables begin with this.
PREFIX = {"android.whatsapp.msgstore": "wa_", "android.whatsapp.calls": "wa_", "android.whatsapp.msgstore.legacy": "lg_"}
TS = "CASE WHEN {c} NOT IN (0, -1) THEN ({c} + 978307200) * 1000000 END"
WAY = "CASE {c} WHEN 1 THEN 'out' WHEN 0 THEN 'in' ELSE 'unknown' END AS direction"


def prefixed(query: str, parser: str, sql: str) -> None:
    from .mapped import SQL, Q

    p = registry.PARSERS[parser]
    names = {n: PREFIX[parser] + n for n in p.needs}
    Q[query] = lambda spark, d: p.run({n: app_table(spark, d, a) for n, a in names.items()})
    SQL[query] = app_sql(tuple(names.values())) + sql


def listing(name: str, key: str, value: str, table: str, alias: str, where: str = "") -> str:
    """A common table: key and the distinct values of a child table, in order."""
    return f", {name} AS (SELECT \"{key}\" AS k, array_to_string(list_sort(coalesce(list(DISTINCT {value}) FILTER (WHERE {value} IS NOT NULL), [])), ',') AS {alias} FROM {table} {where} GROUP BY 1)"


mapped("q_map_chromium_searches", "chromium.searches", f"""{look('urls', 'id', '{u: url, t: last_visit_time}', 'u')}
SELECT keyword_id AS rowid, u.v.t - 11644473600000000 AS ts, term, u.v.u AS url, {STATE.format(k='url_id', a='u')} AS url_state FROM a_keyword_search_terms LEFT JOIN u ON k = url_id""")
mapped("q_map_ios_calls", "ios.calls", f""" SELECT Z_PK AS rowid, {TS.format(c='ZDATE')} AS ts, {TS.format(c='ZDATE')} + ZDURATION * 1000000 AS end_ts, {WAY.format(c='ZORIGINATED')},
CASE WHEN ZANSWERED = 1 THEN 'answered' WHEN ZORIGINATED = 0 THEN 'missed' ELSE 'unknown' END AS outcome, {case('ZCALLTYPE', {1: 'voice', 8: 'video', 16: 'audio'})} AS kind, ZADDRESS AS address FROM a_ZCALLRECORD""")
mapped("q_map_ios_contacts", "ios.addressbook", """, v AS (SELECT record_id, property, concat_ws('=', coalesce(regexp_replace(l.value, '^_\\$!<(.*)>!\\$_$', '\\1'), ''), m.value) AS shown, l.ROWID IS NULL AS bad FROM a_ABMultiValue m LEFT JOIN a_ABMultiValueLabel l ON l.ROWID = m.label)"""
    + listing("ph", "record_id", "CASE WHEN property = 3 THEN shown END", "v", "phones") + listing("em", "record_id", "CASE WHEN property = 4 THEN shown END", "v", "emails")
    + listing("gr", "member_id", "g.Name", "a_ABGroupMembers LEFT JOIN a_ABGroup g ON g.ROWID = group_id", "groups")
    + """, bad AS (SELECT record_id AS k, count(*) FILTER (WHERE bad) AS n FROM v GROUP BY 1)
SELECT ROWID AS rowid, NULL::BIGINT AS ts, concat_ws(' ', First, Last) AS name, phones, emails, groups, coalesce(n, 0) AS unlabelled
FROM a_ABPerson LEFT JOIN ph ON ph.k = ROWID LEFT JOIN em ON em.k = ROWID LEFT JOIN gr ON gr.k = ROWID LEFT JOIN bad ON bad.k = ROWID""")  # fmt: skip
mapped("q_map_ios_calendar", "ios.calendar", look("Calendar", "ROWID", "title", "c") + look("Location", "ROWID", "title", "l")
    + listing("p", "owner_id", "i.display_name", "a_Participant LEFT JOIN a_Identity i ON i.ROWID = identity_id", "attendees")
    + ", pb AS (SELECT owner_id AS k, count(*) FILTER (WHERE i.ROWID IS NULL) AS n FROM a_Participant LEFT JOIN a_Identity i ON i.ROWID = identity_id GROUP BY 1)"
    + listing("a", "calendaritem_owner_id", "trigger_interval", "a_Alarm", "alarms")
    + f""", x AS (SELECT owner_id AS k, count(DISTINCT date) AS n FROM a_ExceptionDate GROUP BY 1)
SELECT ROWID AS rowid, {TS.format(c='start_date')} AS ts, {TS.format(c='end_date')} AS end_ts, summary AS title, all_day = 1 AS all_day, c.v AS calendar, {STATE.format(k='calendar_id', a='c')} AS calendar_state,
l.v AS location, {STATE.format(k='location_id', a='l')} AS location_state, attendees, coalesce(pb.n, 0) AS unresolved, alarms, frequency, coalesce(x.n, 0) AS left_out
FROM a_CalendarItem e LEFT JOIN c ON c.k = calendar_id LEFT JOIN l ON l.k = location_id LEFT JOIN p ON p.k = ROWID LEFT JOIN pb ON pb.k = ROWID LEFT JOIN a ON a.k = ROWID LEFT JOIN a_Recurrence r ON r.owner_id = ROWID LEFT JOIN x ON x.k = ROWID""")  # fmt: skip
prefixed("q_map_whatsapp_messages", "android.whatsapp.msgstore", ", ch AS (SELECT c._id AS k, raw_string, subject FROM a_wa_chat c LEFT JOIN a_wa_jid j ON j._id = c.jid_row_id)"
    + listing("m", "message_row_id", "file_path", "a_wa_message_media", "media") + listing("r", "parent_message_row_id", "reaction", "a_wa_message_add_on", "reactions")
    + f""", qu AS (SELECT message_row_id AS k, min(key_id) AS quotes FROM a_wa_message_quoted GROUP BY 1), b AS (SELECT chat_row_id AS k, max(deleted_message_row_id) AS p, max(deleted_starred_message_row_id) AS s FROM a_wa_deleted_chat_job GROUP BY 1)
SELECT x._id AS rowid, timestamp * 1000 AS ts, {WAY.format(c='from_me')}, ch.raw_string AS chat, subject, CASE WHEN ch.k IS NULL THEN 'unresolved' ELSE 'found' END AS chat_state, s.raw_string AS sender,
CASE WHEN sender_jid_row_id IS NULL THEN 'none' WHEN s._id IS NULL THEN 'unresolved' ELSE 'found' END AS sender_state, text_data AS body, media, quotes, reactions, x._id IN (SELECT message_row_id FROM a_wa_message_revoked) AS revoked,
coalesce(x._id <= CASE WHEN starred = 1 THEN b.s ELSE b.p END, false) AS purged
FROM a_wa_message x LEFT JOIN ch ON ch.k = chat_row_id LEFT JOIN a_wa_jid s ON s._id = sender_jid_row_id LEFT JOIN m ON m.k = x._id LEFT JOIN r ON r.k = x._id LEFT JOIN qu ON qu.k = x._id LEFT JOIN b ON b.k = chat_row_id""")  # fmt: skip
prefixed("q_map_whatsapp_calls", "android.whatsapp.calls", listing("p", "call_log_row_id", "j.raw_string", "a_wa_call_log_participant_v2 LEFT JOIN a_wa_jid j ON j._id = jid_row_id", "participants")
    + f""" SELECT x._id AS rowid, timestamp * 1000 AS ts, timestamp * 1000 + duration * 1000000 AS end_ts, {WAY.format(c='from_me')}, {case('call_result', chats.CALL_RESULTS)} AS outcome, video_call = 1 AS video,
j.raw_string AS address, CASE WHEN j._id IS NULL THEN 'unresolved' ELSE 'found' END AS address_state, participants FROM a_wa_call_log x LEFT JOIN a_wa_jid j ON j._id = jid_row_id LEFT JOIN p ON p.k = x._id""")  # fmt: skip
mapped("q_map_whatsapp_contacts", "android.whatsapp.contacts", """ SELECT _id AS rowid, NULL::BIGINT AS ts, coalesce(nullif(display_name, ''), wa_name) AS name, number, regexp_replace(split_part(jid, '@', 1), ':.*', '') AS "user", split_part(jid, '@', 2) AS server, is_whatsapp_user = 1 AS uses_app FROM a_wa_contacts""")
mapped("q_map_ios_whatsapp_messages", "ios.whatsapp.chats", f"""{look('ZWACHATSESSION', 'Z_PK', '{j: ZCONTACTJID, n: ZPARTNERNAME}', 'c')}{look('ZWAGROUPMEMBER', 'Z_PK', 'ZMEMBERJID', 'm')}{look('ZWAMEDIAITEM', 'Z_PK', 'ZMEDIALOCALPATH', 'f')},
x AS (SELECT * REPLACE (nullif(ZCHATSESSION, 0) AS ZCHATSESSION, nullif(ZGROUPMEMBER, 0) AS ZGROUPMEMBER, nullif(ZMEDIAITEM, 0) AS ZMEDIAITEM) FROM a_ZWAMESSAGE)
SELECT Z_PK AS rowid, {TS.format(c='ZMESSAGEDATE')} AS ts, {WAY.format(c='ZISFROMME')}, c.v.j AS chat, c.v.n AS partner, {STATE.format(k='ZCHATSESSION', a='c')} AS chat_state, CASE WHEN ZISFROMME = 0 THEN coalesce(m.v, c.v.j) END AS sender,
{STATE.format(k='ZGROUPMEMBER', a='m')} AS member_state, f.v AS media, {STATE.format(k='ZMEDIAITEM', a='f')} AS media_state, ZTEXT AS body FROM x LEFT JOIN c ON c.k = ZCHATSESSION LEFT JOIN m ON m.k = ZGROUPMEMBER LEFT JOIN f ON f.k = ZMEDIAITEM""")
CALLS = ", x AS (SELECT * REPLACE (nullif(Z1CALLEVENTS, 0) AS Z1CALLEVENTS) FROM a_ZWACDCALLEVENT), s AS (SELECT Z1CALLEVENTS AS k, count(*) AS n FROM x GROUP BY 1)"
mapped("q_map_ios_whatsapp_calls", "ios.whatsapp.calls", f"""{CALLS}, j AS (SELECT x.*, ZINCOMING, ZVIDEO, CASE WHEN Z1CALLEVENTS IS NULL THEN 'no-aggregate' WHEN a.Z_PK IS NULL THEN 'unresolved' WHEN s.n > 1 THEN 'several-calls' ELSE 'aggregate' END AS st
FROM x LEFT JOIN a_ZWAAGGREGATECALLEVENT a ON a.Z_PK = Z1CALLEVENTS LEFT JOIN s ON s.k = Z1CALLEVENTS)
SELECT Z_PK AS rowid, {TS.format(c='ZDATE')} AS ts, {TS.format(c='ZDATE')} + ZDURATION * 1000000 AS end_ts, CASE WHEN st <> 'aggregate' THEN 'unknown' WHEN ZINCOMING = 1 THEN 'in' ELSE 'out' END AS direction, st AS direction_state, ZVIDEO = 1 AS video, ZOUTCOME AS raw_outcome FROM j""")
mapped("q_map_ios_whatsapp_contacts", "ios.whatsapp.contacts", """ SELECT Z_PK AS rowid, NULL::BIGINT AS ts, ZFULLNAME AS name, ZPHONENUMBER AS number, split_part(ZWHATSAPPID, '@', 1) AS "user", split_part(ZWHATSAPPID, '@', 2) AS server FROM a_ZWAADDRESSBOOKCONTACT""")
mapped("q_map_telegram_messages", "android.telegram", f""", x AS (SELECT *, CASE WHEN uid >= 4294967296 THEN 'secret' WHEN uid < 0 THEN 'chat' WHEN uid > 0 THEN 'user' END AS kind FROM a_messages),
y AS (SELECT x.*, CASE WHEN kind = 'user' THEN x.uid ELSE e."user" END AS u, e.uid AS e FROM x LEFT JOIN a_enc_chats e ON kind = 'secret' AND e.uid = x.uid // 4294967296)
SELECT mid AS rowid, date * 1000000 AS ts, {WAY.format(c='out')}, kind AS dialog_kind, coalesce(us.name, c.name) AS dialog,
CASE WHEN kind = 'chat' THEN CASE WHEN c.uid IS NULL THEN 'unresolved' ELSE 'found' END WHEN kind = 'secret' AND e IS NULL THEN 'unresolved' WHEN u IS NULL THEN 'none' WHEN us.uid IS NULL THEN 'unresolved' ELSE 'found' END AS dialog_state, message AS body
FROM y LEFT JOIN a_users us ON us.uid = u LEFT JOIN a_chats c ON kind = 'chat' AND c.uid = -y.uid""")
mapped("q_map_telegram_contacts", "android.telegram.contacts", """ SELECT c.uid AS rowid, NULL::BIGINT AS ts, name, phone, mutual = 1 AS mutual, CASE WHEN u.uid IS NULL THEN 'unresolved' ELSE 'found' END AS user_state FROM a_contacts c LEFT JOIN a_users u ON u.uid = c.uid""")


def _apps(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return {n.removeprefix("wa_"): app_table(spark, d, n) for n in names}


def register() -> None:
    """Adds what the mappings have besides their records."""
    from .mapped import SQL, Q

    Q["q_call_aggregates"] = lambda s, d: chats.call_aggregates(_apps(s, d, "ZWACDCALLEVENT", "ZWAAGGREGATECALLEVENT"))
    SQL["q_call_aggregates"] = app_sql(("ZWACDCALLEVENT", "ZWAAGGREGATECALLEVENT")) + f""", c AS (SELECT Z1CALLEVENTS AS k, count(*) AS n, count(*) FILTER (WHERE ZDURATION > 0) AS a, min(ZDATE) AS lo, max(ZDATE) AS hi, sum(ZDURATION)::BIGINT AS s FROM a_ZWACDCALLEVENT GROUP BY 1)
SELECT Z_PK AS aggregate, coalesce(n, 0) AS calls, coalesce(a, 0) AS answered, {TS.format(c='lo')} AS first_ts, {TS.format(c='hi')} AS last_ts, coalesce(s, 0) AS seconds FROM a_ZWAAGGREGATECALLEVENT LEFT JOIN c ON k = Z_PK"""
    Q["q_purge_bounds"] = lambda s, d: chats.purge_bounds(app_table(s, d, "wa_deleted_chat_job"))
    SQL["q_purge_bounds"] = app_sql(("wa_deleted_chat_job",)) + " SELECT chat_row_id AS chat, count(*) AS jobs, min(_id) AS first_job, max(deleted_message_row_id) AS purged_to, max(deleted_starred_message_row_id) AS purged_starred_to FROM a_wa_deleted_chat_job GROUP BY 1"
