"""Registered queries of cells that aren't known and of joins with three outcomes.

The tables are those of the mappings with some cells unread, by conditions in SQL of both engines; the SQL forms follow the rules
of the joins over these tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import cells
from tracelake.mappings import registry
from tracelake.operators import keyjoin

from .mapped import APP, app_sql, app_table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Unread cells of app tables: cell, condition, how.
UNREAD = {
    "urls": (("id", "id % 97 = 0", "unread"), ("title", "id % 7 = 1", "clipped")),
    "visits": (("url", "id % 13 = 0", "unread"), ("transition", "id % 17 = 3", "omitted")),
    "message": (("handle_id", "ROWID % 11 = 0", "unread"), ("date", "ROWID % 19 = 1", "unread")),
    "handle": (("id", "ROWID % 5 = 2", "clipped"),),
    "chat_message_join": (("message_id", "message_id % 101 = 7", "unread"),),
    "chat_handle_join": (("handle_id", "handle_id % 23 = 4", "unread"),),
    "message_attachment_join": (("attachment_id", "attachment_id % 40 = 0", "unread"),),
    "pdu": (("msg_box", "_id % 29 = 0", "unread"),),
    "addr": (("address", "msg_id % 31 = 2", "unread"),),
    "part": (("mid", "_id + mid = 9", "unread"), ("text", "seq + mid % 8 = 1", "clipped")),
}


def unread(spark: SparkSession, d: str, name: str) -> DataFrame:
    """An app table with ``_unknown`` and without the cells that it names."""
    table = app_table(spark, d, name)
    gaps = UNREAD.get(name, ())
    states = F.map_from_entries(F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("k"), F.lit(how).alias("v"))) for n, c, how in gaps]), lambda x: x.isNotNull()))
    if not gaps:
        return table
    return table.select(*[F.when(~F.expr(c), F.col(n)).alias(n) if (c := next((c for g, c, _ in gaps if g == n), None)) else F.col(n) for n in table.columns], states.alias("_unknown"))


def unread_sql(names: tuple[str, ...]) -> str:
    """a_ tables as they are, b_ tables with unread cells as nulls and a flag cell_u for each."""
    out = app_sql(names)
    for n in names:
        gaps = UNREAD.get(n, ())
        cut = ", ".join(f"CASE WHEN NOT ({c}) THEN {g} END AS {g}" for g, c, _ in gaps)
        out += f', "b_{n}" AS (SELECT * {f"REPLACE ({cut})" if cut else ""} {"".join(f", ({c}) AS {g}_u" for g, c, _ in gaps)} FROM "a_{n}")'
    return out


def unknown(query: str, parser: str, columns: tuple[str, ...], sql: str, optional: tuple[str, ...] = ()) -> None:
    p = registry.PARSERS[parser]
    names = (*p.needs, *optional)

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = registry.records(p, {n: unread(spark, d, n) for n in names})
        said = ("unknown_columns", "joined_unknown_columns", "join_undecided", "join_short")
        return out.select("rowid", "ts", *[F.get_json_object("payload", f"$.{c}").alias(c) for c in (*columns, *said)])

    Q[query], SQL[query] = run, unread_sql(names) + sql


def _json(kind: str, *items: tuple[str, str]) -> str:
    """SQL: a JSON object or list of what holds, null if nothing does."""
    texts = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in items)
    a, z = ("{", "}") if kind == "map" else ("[", "]")
    return f"nullif('{a}' || concat_ws(',', {texts}) || '{z}', '{a}{z}')"


STATE = "CASE WHEN {u} THEN 'undecided' WHEN {k} IS NULL THEN 'none' WHEN {a}.n IS NULL AND {gap} THEN 'undecided' WHEN {a}.n IS NULL THEN 'unresolved' WHEN {a}.n > 1 THEN 'ambiguous' ELSE 'found' END"
LOST = "EXISTS (SELECT 1 FROM {t} WHERE {c})"
URLS = STATE.format(u="url_u", k="x.url", a="u", gap=LOST.format(t="b_urls", c="id_u"))
unknown("q_unknown_visits", "chromium.history", ("kind", "url", "url_state", "title"), f""", u AS (SELECT id, count(*) AS n, any_value(url) AS url, any_value(title) AS title, any_value(title_u) AS title_u FROM b_urls WHERE NOT id_u GROUP BY 1),
s AS (SELECT x.id AS rowid, visit_time - 11644473600000000 AS ts, 'visit' AS kind, u.url, {URLS} AS url_state, u.title, url_u, transition_u, u.title_u FROM b_visits x LEFT JOIN u ON u.id = x.url)
SELECT rowid, ts, kind, url, url_state, title, {_json('map', ('"transition":"omitted"', 'transition_u'), ('"url":"unread"', 'url_u'))} AS unknown_columns, {_json('map', ('"url.title":"clipped"', "url_state = 'found' AND title_u"))} AS joined_unknown_columns,
  {_json('list', ('"url"', "url_state = 'undecided'"))} AS join_undecided, {_json('list', ('"url"', "url_state IN ('found', 'ambiguous') AND " + LOST.format(t="b_urls", c="id_u")))} AS join_short FROM s
UNION ALL SELECT id, last_visit_time - 11644473600000000, 'url', url, 'found', title, {_json('map', ('"id":"unread"', 'id_u'), ('"title":"clipped"', 'title_u'))}, NULL, {_json('list', ('"visits"', 'id_u OR ' + LOST.format(t='b_visits', c='url_u')))}, NULL
FROM b_urls y WHERE id_u OR NOT EXISTS (SELECT 1 FROM b_visits z WHERE z.url = y.id)""")

unknown("q_unknown_messages", "ios.sms", ("address", "handle_state", "members", "chats", "attachments"), f""", h AS (SELECT ROWID AS k, count(*) AS n, any_value(id) AS id, any_value(id_u) AS id_u FROM b_handle GROUP BY 1),
p AS (SELECT chat_id AS c, array_to_string(list_sort(coalesce(list(DISTINCT h.id) FILTER (WHERE h.id IS NOT NULL), [])), ',') AS members, bool_or(handle_id_u) AS short FROM b_chat_handle_join j LEFT JOIN h ON h.k = j.handle_id GROUP BY 1),
m AS (SELECT message_id AS k, arg_min({{'m': CASE WHEN short THEN nullif(members, '') ELSE members END}}, chat_id).m AS members, count(DISTINCT chat_id) AS chats FROM b_chat_message_join JOIN p ON c = chat_id WHERE NOT message_id_u GROUP BY 1),
f AS (SELECT message_id AS k, count(DISTINCT attachment_id) AS n, bool_or(attachment_id_u) AS short FROM b_message_attachment_join GROUP BY 1),
s AS (SELECT x.*, h.id AS address, h.id_u, {STATE.format(u='x.handle_id_u', k='x.handle_id', a='h', gap='false')} AS handle_state, m.k IS NULL AND {LOST.format(t='b_chat_message_join', c='message_id_u')} AS open, CASE WHEN {LOST.format(t='b_chat_message_join', c='message_id_u')} THEN nullif(m.members, '') ELSE m.members END AS members, m.chats, f.n AS files, f.short AS files_short
      FROM b_message x LEFT JOIN h ON h.k = x.handle_id LEFT JOIN m ON m.k = x.ROWID LEFT JOIN f ON f.k = x.ROWID)
SELECT ROWID AS rowid, (date + 978307200) * 1000000 AS ts, address, handle_state, members, CASE WHEN NOT open THEN coalesce(chats, 0)::VARCHAR END AS chats, coalesce(files, 0)::VARCHAR AS attachments,
  {_json('map', ('"date":"unread"', 'date_u'), ('"handle_id":"unread"', 'handle_id_u'))} AS unknown_columns, {_json('map', ('"handle.id":"clipped"', "handle_state = 'found' AND id_u"))} AS joined_unknown_columns,
  {_json('list', ('"chat_message_join"', 'open'), ('"handle"', "handle_state = 'undecided'"))} AS join_undecided, {_json('list', ('"chat_message_join"', f"chats IS NOT NULL AND {LOST.format(t='b_chat_message_join', c='message_id_u')}"), ('"message_attachment_join"', 'files_short'))} AS join_short FROM s""", ("chat_handle_join", "message_attachment_join"))

unknown("q_unknown_mms", "android.mms", ("direction", "receivers", "body", "attachments"), f""", p AS (SELECT msg_id AS k, array_to_string(list_sort(coalesce(list(DISTINCT address) FILTER (WHERE type = 151 AND address IS NOT NULL), [])), ',') AS receivers, bool_or(address_u) AS short FROM b_addr GROUP BY 1),
b AS (SELECT mid, coalesce(string_agg(text, chr(10) ORDER BY seq, _id, text) FILTER (WHERE ct = 'text/plain'), '') AS body, count(*) FILTER (WHERE ct = 'image/png') AS n, bool_or(text_u) AS short FROM b_part WHERE NOT mid_u GROUP BY 1),
s AS (SELECT x.*, receivers, p.short AS a_short, body, n, b.mid IS NOT NULL AS held, b.short, {LOST.format(t='b_part', c='mid_u')} AS lost FROM b_pdu x LEFT JOIN p ON k = _id LEFT JOIN b ON mid = _id)
SELECT _id AS rowid, date * 1000000 AS ts, CASE msg_box WHEN 1 THEN 'in' WHEN 3 THEN 'draft' WHEN 2 THEN 'out' WHEN 4 THEN 'out' ELSE 'unknown' END AS direction, CASE WHEN a_short THEN nullif(receivers, '') ELSE receivers END AS receivers, CASE WHEN lost OR short THEN nullif(body, '') ELSE body END AS body, CASE WHEN held OR NOT lost THEN coalesce(n, 0)::VARCHAR END AS attachments,
  {_json('map', ('"msg_box":"unread"', 'msg_box_u'))} AS unknown_columns, NULL::VARCHAR AS joined_unknown_columns, {_json('list', ('"part"', 'NOT held AND lost'))} AS join_undecided, {_json('list', ('"addr"', 'a_short'), ('"part"', 'held AND (lost OR short)'))} AS join_short FROM s""")

# Key joins of cells of mixed kinds: a text column against a numeric one, and a numeric column against texts.
PROBE = "l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_partkey END AS i, CASE WHEN l_linenumber = 2 THEN l_quantity + l_suppkey % 2 / 2 END AS r, CASE l_linenumber WHEN 3 THEN concat(' ', cast(l_partkey AS string), CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.0' ELSE '0000000000000000001' END) WHEN 4 THEN concat(l_returnflag, cast(l_partkey AS string)) END AS t, CASE WHEN l_linenumber = 5 THEN 'unread' END AS s"
BUILD = "p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS i, CASE WHEN p_partkey % 3 = 1 THEN p_size / 2 END AS r, CASE WHEN p_partkey % 3 = 2 THEN concat(cast(p_partkey AS string), CASE WHEN p_size = 7 THEN 'x' ELSE '' END) END AS t"


def _cells(spark: SparkSession, d: str, table: str, columns: str) -> DataFrame:
    out = spark.sql(f"SELECT {columns} FROM {{t}}", t=spark.read.parquet(f"{d}/{table}.parquet"))
    return out.withColumn("c", cells.cell(i=F.col("i"), r=F.col("r"), t=F.col("t"))).drop("i", "r", "t")


def _key_join(own: str, other: str, state: str) -> Callable[[SparkSession, str], tuple]:
    def run(spark: SparkSession, d: str) -> tuple:
        build = _cells(spark, d, "part", BUILD).withColumn("s", F.expr(state))
        on, to = keyjoin.Side("c", "s", own), keyjoin.Side("c", "s", other)
        return keyjoin.outcomes(_cells(spark, d, "lineitem", PROBE), on, build, to, {"part": "p_partkey"}), on, build, to

    return run


#: A text's number where it reads as one exactly; beyond that it is undecided. Keys: n and the number, t and the text.
EXACT = r"regexp_full_match(trim({t}), '[+-]?[0-9]{{1,18}}') OR regexp_full_match(trim({t}), '[+-]?[0-9]{{1,13}}[.][0-9]{{1,2}}')"
LIKE = r"coalesce(regexp_full_match(trim({t}), '[+-]?[0-9]+([.][0-9]+)?') AND NOT ({e}), false)"
NUMBER = "'n' || TRY_CAST({x} AS DOUBLE)"


def _key_sql(own: str, other: str, state: str) -> str:
    exact = EXACT.format(t="t")
    inexact = LIKE.format(t="t", e=exact)
    number = f"coalesce({NUMBER.format(x='i')}, {NUMBER.format(x='r')})"
    text = f"CASE WHEN {exact} THEN {NUMBER.format(x='trim(t)')} ELSE 't' || t END" if (own, other) == ("text", "numeric") else "'t' || t"
    return f"""WITH x AS (SELECT {PROBE.replace('string', 'VARCHAR')} FROM lineitem), y AS (SELECT {BUILD.replace('string', 'VARCHAR')}, {state} AS s FROM part),
p AS (SELECT *, coalesce({number}, {text}) AS key, s IS NULL AND NOT {inexact if (own, other) == ('text', 'numeric') else 'false'} AS fits FROM x),
e AS (SELECT p_partkey, coalesce({number}, 't' || t) AS key FROM y WHERE s IS NULL {f"UNION ALL SELECT p_partkey, {NUMBER.format(x='trim(t)')} FROM y WHERE s IS NULL AND ({exact})" if own == 'numeric' and other != 'numeric' else ''}),
b AS (SELECT key, count(*) AS n, any_value(p_partkey) AS part FROM e WHERE key IS NOT NULL GROUP BY 1),
o AS (SELECT p.*, b.n, b.part, (SELECT count(*) FROM y WHERE s IS NOT NULL) > 0 {f"OR ((i IS NOT NULL OR r IS NOT NULL) AND (SELECT count(*) FROM y WHERE s IS NULL AND {inexact}) > 0)" if own == 'numeric' and other != 'numeric' else ''} AS open FROM p LEFT JOIN b ON b.key = p.key AND fits),
j AS (SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN part END AS part, coalesce(n, 0) AS hits, CASE WHEN s IS NULL AND i IS NULL AND r IS NULL AND t IS NULL THEN 'none' WHEN NOT fits THEN 'undecided' WHEN n > 0 THEN 'match' WHEN open THEN 'undecided' ELSE 'miss' END AS outcome, n IS NOT NULL AND open AS short FROM o)
"""


for _name, _own, _other, _state in (("q_key_join_texts", "text", "numeric", "CASE WHEN p_partkey < 0 THEN 'unread' END"), ("q_key_join_numbers", "numeric", "text", "CASE WHEN p_partkey % 100 = 50 THEN 'clipped' END")):
    Q[_name] = lambda s, d, f=_key_join(_own, _other, _state): f(s, d)[0].select("l_orderkey", "l_linenumber", "part", "hits", "outcome", "short")
    SQL[_name] = _key_sql(_own, _other, _state) + "SELECT * FROM j"
    Q[_name + "_report"] = lambda s, d, f=_key_join(_own, _other, _state): keyjoin.report(*f(s, d), "part", "key")
    SQL[_name + "_report"] = _key_sql(_own, _other, _state) + ", ".join(
        ["SELECT 'part' AS \"table\", 'key' AS \"column\", count(*) AS lookups", *[f"count(*) FILTER (WHERE outcome = '{o}') AS \"{o}\"" for o in ("match", "miss", "undecided", "none")], "count(*) FILTER (WHERE short) AS short", "(SELECT count(*) FROM y WHERE s IS NOT NULL) AS unkeyed, false AS collation_differs, true AS class_differs FROM j"]
    )

assert set(UNREAD) <= set(APP)
