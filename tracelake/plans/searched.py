"""Registered queries of full-text search, each with its DuckDB form. The postings of a table folder are built once for each session."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import filters, listing, search, stats
from tracelake.operators.filters import Filter
from tracelake.operators.search import Item, item
from tracelake.sources import records as R
from tracelake.sources.staging import fingerprint, new_path

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKENS = "regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"
FULL = TOKENS.replace("strip_accents(lower(coalesce({c}, '')))", "replace(strip_accents(lower(coalesce({c}, ''))), 'ß', 'ss')")
RECORDS = "WITH " + R.sql_records()
TEXTS = RECORDS + ", x AS (SELECT *, ' ' || array_to_string(" + FULL.format(c="summary") + ", ' ') || ' ' AS s, ' ' || array_to_string(" + FULL.format(c="body") + ", ' ') || ' ' AS b FROM records WHERE type = 'message') "
POSTINGS = RECORDS + ", y AS (SELECT id, 'summary' AS col, " + FULL.format(c="summary") + " AS w FROM records WHERE type = 'message' UNION ALL SELECT id, 'body', " + FULL.format(c="body") + " FROM records WHERE type = 'message'), p AS (SELECT id, col, unnest(range(len(w)))::INT AS pos, unnest(w) AS term FROM y) "
_BUILT: dict[tuple, str] = {}


def texts(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply(R.records(spark, d), Filter(types=("message",)))


def index(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings of the messages in a folder."""
    return search.read_index(spark, index_path(spark, d))


def index_path(spark: SparkSession, d: str) -> str:
    """Where the index of a folder is, as its tables are now; built at the first call."""
    key = (spark.sparkContext.applicationId, d, fingerprint(texts(spark, d)))
    if key not in _BUILT:
        path = new_path(spark, "postings")
        search.build_index(texts(spark, d), path)
        _BUILT[key] = path
    return _BUILT[key]


def notes(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply(R.records(spark, d), Filter(types=("note",)))


def _search(name: str, groups: Sequence[Sequence[Item]], where: str, columns: tuple[str, ...] = search.COLUMNS) -> None:
    Q[name] = lambda s, d: search.matching(texts(s, d), index(s, d), groups, columns).select("id", "summary")
    SQL[name] = TEXTS + f"SELECT id, summary FROM x WHERE {where}"


def _any(needle: str) -> str:
    return f"(contains(s, '{needle}') OR contains(b, '{needle}'))"


_search("q_search_word", [[item("the")]], _any(" the "))
_search("q_search_and_not", [[item("the"), item("of"), item("that", negative=True)]], f"{_any(' the ')} AND {_any(' of ')} AND NOT {_any(' that ')}")
_search("q_search_or", [[item("than")], [item("whed")], [item("user")]], f"{_any(' than ')} OR {_any(' whed ')} OR {_any(' user ')}")
_search("q_search_phrase", [[item("of the")]], _any(" of the "))
_search("q_search_prefix", [[item("assis", prefix=True)]], _any(" assis"))
_search("q_search_phrase_prefix", [[item("of the th", prefix=True), item("user", negative=True)]], f"{_any(' of the th')} AND NOT {_any(' user ')}")
_search("q_search_column", [[item("assistant")]], "contains(s, ' assistant ')", ("summary",))
FOUND = f"SELECT id FROM x WHERE {_any(' the ')} AND NOT {_any(' of ')}"
GROUPS = [[item("the"), item("of", negative=True)]]
Q["q_search_stats"] = lambda s, d: stats.stats(search.matching(filters.apply(R.records(s, d), Filter(types=("message",), artifact_ids=("c1", "c2"))), index(s, d), GROUPS), "artifact")
SQL["q_search_stats"] = TEXTS + f"SELECT artifact_id AS key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM x WHERE artifact_id IN ('c1', 'c2') AND id IN ({FOUND}) GROUP BY 1"
Q["q_search_list"] = lambda s, d: listing.page(search.matching(texts(s, d), index(s, d), GROUPS), 100, True)
SQL["q_search_list"] = TEXTS + f"SELECT {', '.join(listing.LIST_COLUMNS)} FROM x WHERE id IN ({FOUND}) ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 100"
Q["q_search_count"] = lambda s, d: listing.count_capped(search.matching(texts(s, d), index(s, d), GROUPS), 500)
SQL["q_search_count"] = TEXTS + f"SELECT least(count(*), 500)::BIGINT AS n, count(*) > 500 AS capped FROM ({FOUND})"
HATI = "(contains(strip_accents(lower(coalesce(summary, ''))), 'hati') OR contains(strip_accents(lower(coalesce(body, ''))), 'hati'))"
Q["q_search_substring"] = lambda s, d: search.substring(texts(s, d), "HATI").select("id")
SQL["q_search_substring"] = RECORDS + f" SELECT id FROM records WHERE type = 'message' AND {HATI}"
Q["q_search_trigrams"] = lambda s, d: search.substring(texts(s, d), "haTIon", grams=search.trigram_postings(texts(s, d))).select("id")
SQL["q_search_trigrams"] = RECORDS + " SELECT id FROM records WHERE type = 'message' AND " + HATI.replace("hati", "hation")
Q["q_search_scan"] = lambda s, d: search.scan(texts(s, d), "a ")
SQL["q_search_scan"] = RECORDS + ", z AS (SELECT contains(strip_accents(lower(coalesce(summary, ''))), 'a ') AS s, contains(strip_accents(lower(coalesce(body, ''))), 'a ') AS b FROM records WHERE type = 'message') SELECT count(*) AS scanned, count(*) FILTER (WHERE s OR b) AS found, count(*) FILTER (WHERE s) AS found_summary, count(*) FILTER (WHERE b) AS found_body FROM z"
TERMS = ["the", "of", "zebra", "licensed"]
Q["q_term_hits"] = lambda s, d: search.term_hits(search.postings(notes(s, d), ("body",), full=False), TERMS)
SQL["q_term_hits"] = RECORDS + " SELECT t.term, count(r.id) AS n FROM (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") t(term) LEFT JOIN (SELECT id, unnest(list_distinct(" + TOKENS.format(c="body") + ")) AS term FROM records WHERE type = 'note') r ON r.term = t.term GROUP BY t.term"
Q["q_keyword_ids"] = lambda s, d: search.term_hits(index(s, d), ["The", "Öf", "zebra", "user"], ids=5).select("term", "n", F.array_join("ids", ",").alias("ids"))
SQL["q_keyword_ids"] = POSTINGS + ", h AS (SELECT DISTINCT term, id FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY id) AS i FROM h) SELECT t.term, count(r.id) AS n, coalesce(string_agg(r.id::VARCHAR, ',' ORDER BY r.id) FILTER (WHERE i <= 5), '') AS ids FROM (VALUES ('The', 'the'), ('Öf', 'of'), ('zebra', 'zebra'), ('user', 'user')) t(term, w) LEFT JOIN r ON r.term = t.w GROUP BY 1"
IDF = "greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE)"
ONE = "- " + IDF + " * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))"
Q["q_search_rank"] = lambda s, d: search.ranked(index(s, d), ["assistant", "with"], 50).select("id", F.round("score", 6).alias("score"))
SQL["q_search_rank"] = POSTINGS + ", z AS (SELECT id, count(*) AS len, " + ", ".join(f"sum(CASE WHEN term = '{t}' THEN CASE col WHEN 'summary' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END) AS tf{i}" for i, t in enumerate(("assistant", "with"))) + " FROM p GROUP BY id), g AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM z), r AS (SELECT id, 0.0::DOUBLE " + ONE.format(i=0) + " " + ONE.format(i=1) + " AS score FROM z, g WHERE tf0 > 0 AND tf1 > 0) SELECT id, round(score, 6) AS score FROM r ORDER BY r.score, id LIMIT 50"
Q["q_postings"] = lambda s, d: index(s, d).groupBy("col", "term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"), F.min("pos").cast("bigint").alias("first_pos"))
SQL["q_postings"] = POSTINGS + "SELECT col, term, count(*) AS n, count(DISTINCT id) AS docs, min(pos)::BIGINT AS first_pos FROM p GROUP BY 1, 2"
Q["q_trigram_postings"] = lambda s, d: search.trigram_postings(texts(s, d), ("body",)).groupBy("gram").agg(F.count("*").alias("docs"))
SQL["q_trigram_postings"] = RECORDS + ", t AS (SELECT id, strip_accents(lower(body)) AS b FROM records WHERE type = 'message' AND body IS NOT NULL), g AS (SELECT DISTINCT id, substr(b, i, 3) AS gram FROM t, LATERAL (SELECT unnest(range(1, length(b) - 1)) AS i)) SELECT gram, count(*) AS docs FROM g GROUP BY 1"
Q["q_index_docs"] = lambda s, d: search.docs_per_column(index(s, d))
SQL["q_index_docs"] = POSTINGS + "SELECT col, count(DISTINCT id) AS docs, count(*) AS terms FROM p GROUP BY col"
DIGEST = "(id - 1) // 100000 AS batch_no, count(*) AS n, sum(('0x' || substr(md5('k|' || id || '|' || col || '|' || pos || '|' || term || ''), 1, 15))::HUGEINT)::VARCHAR AS digest"
Q["q_postings_digest"] = lambda s, d: search.postings_digest(index(s, d), "k", 100_000).withColumn("digest", F.col("digest").cast("string"))
SQL["q_postings_digest"] = POSTINGS + f"SELECT {DIGEST} FROM p GROUP BY 1"
Q["q_index_proof"] = lambda s, d: search.index_proof(index(s, d).where("id % 300000 <> 7 AND (id - 1) div 100000 % 5 <> 1"), texts(s, d), "k", 100_000)
SQL["q_index_proof"] = POSTINGS + f", r AS (SELECT {DIGEST} FROM p GROUP BY 1), i AS (SELECT {DIGEST} FROM p WHERE id % 300000 <> 7 AND (id - 1) // 100000 % 5 <> 1 GROUP BY 1) SELECT batch_no, CASE WHEN i.digest IS NULL THEN 'missing' WHEN i.digest = r.digest THEN 'equal' ELSE 'differs' END AS state FROM r LEFT JOIN i USING (batch_no)"
Q["q_search_rank_stored"] = lambda s, d: search.ranked_stored(s, index_path(s, d), ["assistant", "with"], 50).select("id", F.round("score", 6).alias("score"))
SQL["q_search_rank_stored"] = SQL["q_search_rank"]
Q["q_snippet_exact"] = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", search.exact_snippet(F.col("text"), "Cion", 90).alias("x")).where("x IS NOT NULL").select("doc_id", F.col("x.text").alias("snippet"), F.size("x.spans").cast("bigint").alias("hits"), F.get("x.spans", F.lit(0))["start"].cast("bigint").alias("first_at"))
SQL["q_snippet_exact"] = "WITH y AS (SELECT doc_id, text, strip_accents(lower(text)) AS f FROM documents), z AS (SELECT *, greatest(1, strpos(f, 'cion') - 22) AS p FROM y WHERE contains(f, 'cion')) SELECT doc_id, substr(text, p, 90) AS snippet, (len(string_split(substr(f, p, 90), 'cion')) - 1)::BIGINT AS hits, (strpos(substr(f, p, 90), 'cion') - 1)::BIGINT AS first_at FROM z"
Q["q_snippet"] = lambda s, d: texts(s, d).select("id", search.snippet(F.col("body"), "the", 60).alias("x")).where("x IS NOT NULL").select("id", F.col("x.text").alias("snippet"), F.size("x.at").cast("bigint").alias("hits"), F.get("x.at", F.lit(0)).cast("bigint").alias("first_at"))
SQL["q_snippet"] = RECORDS + ", y AS (SELECT id, body, strip_accents(lower(body)) AS f FROM records WHERE type = 'message'), z AS (SELECT *, greatest(1, strpos(f, 'the') - 15) AS p FROM y WHERE contains(f, 'the')) SELECT id, substr(body, p, 60) AS snippet, (len(string_split(substr(f, p, 60), 'the')) - 1)::BIGINT AS hits, (strpos(substr(f, p, 60), 'the') - 1)::BIGINT AS first_at FROM z"


def capped_groups(recs: DataFrame, by: str, most: int) -> DataFrame:
    """The first groups in key order; more says whether there are others."""
    return stats.capped(stats.stats(recs, by), most)


Q["q_groups_capped"] = lambda s, d: capped_groups(R.records(s, d), "artifact", 7)
SQL["q_groups_capped"] = RECORDS + ", g AS (SELECT artifact_id AS key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM records GROUP BY 1) SELECT *, (SELECT count(*) > 7 FROM g) AS more FROM g ORDER BY key NULLS FIRST LIMIT 7"
