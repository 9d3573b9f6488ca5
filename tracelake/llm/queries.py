"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, hard_negatives, html_extract, jaccard_join, mixing, packing, pii, quality_knn, quality_rules, suffix_dedup, toxicity
from .common import WORD, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.host_verdicts(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) x(k) GROUP BY doc_id),
q AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rw.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
  FROM d LEFT JOIN rw USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             100 * n_symbols > 20 * n_words OR 100 * n_bangs > 40 * n_words AS grave,
             100 * n_symbols > 10 * n_words OR n_dup_lines >= 3 OR NOT (word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 18.0) AS mild FROM q),
h AS (SELECT source, count(*) AS n, sum((base_failed OR grave OR mild)::INT) AS f FROM j GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS m, var_samp(f / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v IS NULL THEN 1.0 WHEN v = 0 THEN 1e6 ELSE least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) END AS k FROM p),
v AS (SELECT source, (f + k * m) / (n + k) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR grave OR (mild AND host_rate > 0.5)) AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source"""


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed("_pii_found", "n_replaced")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    out = chat.format_chats(chat.pack_conversations(rows.unionByName(tricky))).withColumn("_read", chat.read_turns(F.col("_formatted")))
    out = out.withColumn("_lost", chat.loss_text(F.col("_formatted"), F.col("_loss")))
    lines = F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select("conv_id", F.size("_read").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length("_lost").cast("long").alias("loss_chars"), F.sha2("_lost", 256).alias("loss_sha256"), F.length("_formatted").cast("long").alias("formatted_chars"))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS esc FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 1 + length(esc) + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || doc_id) AS ord FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level FROM s1
       WINDOW f AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, least(cap, coalesce(w * first_value(CASE WHEN cap > w * level THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), cap)) AS target FROM s2),
s4 AS (SELECT *, greatest(1, least(64, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 100)))::BIGINT AS block,
              greatest(1, ceil(source_size / greatest(100000, sum(source_size) OVER () / 200000)))::BIGINT AS shards FROM s3),
s5 AS (SELECT *, round(sum(target) OVER () / block)::BIGINT AS seats FROM s4),
won AS (SELECT source, k FROM (SELECT source, target, seats, unnest(range(1, seats + 1)) AS k FROM s5 WHERE target > 0)
        QUALIFY row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source IS NULL, source) <= seats),
q AS (SELECT source, count(*) AS n FROM won GROUP BY source),
s6 AS (SELECT s5.*, least(coalesce(q.n, 0), 3 * ceil(source_size / block))::BIGINT AS quota FROM s5 LEFT JOIN q ON s5.source IS NOT DISTINCT FROM q.source),
p AS (SELECT d.*, source_size, target, block, quota, (('0x' || substr(ord, 25, 8))::BIGINT) % shards AS shard FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
sh AS (SELECT source, shard, sum(size)::BIGINT AS ssize, any_value(block) AS block, any_value(quota) AS quota FROM p GROUP BY source, shard),
wsh AS (SELECT source, shard FROM (SELECT *, unnest(range(1, quota + 1)) AS k FROM sh WHERE ssize > 0)
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY ssize / (2 * k - 1) DESC, source IS NULL, source, shard) <= quota),
qs AS (SELECT source, shard, count(*) AS n FROM wsh GROUP BY source, shard),
sh2 AS (SELECT sh.source, sh.shard, ceil(ssize / block)::BIGINT AS nb, least(coalesce(qs.n, 0), 3 * ceil(ssize / block))::BIGINT AS seats,
        floor(('0x' || substr(md5('17:' || coalesce(sh.source, '') || ':' || sh.shard), 1, 8))::BIGINT / 4294967296.0::DOUBLE * ceil(ssize / block))::BIGINT AS u
        FROM sh LEFT JOIN qs ON sh.source IS NOT DISTINCT FROM qs.source AND sh.shard = qs.shard),
l AS (SELECT p.*, nb, seats, u, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS b
      FROM p JOIN sh2 ON p.source IS NOT DISTINCT FROM sh2.source AND p.shard = sh2.shard),
c AS (SELECT *, b - size AS a, greatest(nb, 1) AS m FROM l)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN
  ((b // block) * seats + u) // m * block + (b % block) * (((b // block + 1) * seats + u) // m - ((b // block) * seats + u) // m)
  - ((a // block) * seats + u) // m * block - (a % block) * (((a // block + 1) * seats + u) // m - ((a // block) * seats + u) // m) ELSE 0 END::BIGINT AS taken
FROM c"""


def _held_out(modulus: int, remainder: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder


def _labelled(spark: SparkSession, sf_dir: str, label: str, modulus: int, remainder: int) -> DataFrame:
    """Texts and labels of the rows that may be learnt from."""
    labels = table(spark, sf_dir, "labels").where(~_held_out(modulus, remainder)).select("doc_id", F.col(label).alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels.where("label IS NOT NULL"), "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(_labelled(spark, sf_dir, "toxic", 5, 0))
    out = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("doc_id", _held_out(5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_knn.fit(_labelled(spark, sf_dir, "quality", 4, 2))
    out = quality_knn.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("doc_id", _held_out(4, 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"), size=4, pct=85)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS gram FROM g UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS pos FROM d UNION SELECT r.doc_id, links.y FROM r JOIN links ON links.x = r.pos)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(pos) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_main_text").alias("text"), F.length("_main_text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("_matches").alias("m"))
    return found.select("doc_id", "m.item_id", F.col("m.cosine").alias("cosine"), F.col("m.lcs").alias("lcs"), F.col("m.answer").alias("answer"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS s FROM d, LATERAL (SELECT unnest(range(1, n - 98)) AS i)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l),
t AS (SELECT doc_id, i, sum(CASE WHEN b >= i - 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM t GROUP BY 1, 2),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER p, 1) AS from_, lead(a) OVER p IS NULL AS last FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY a)),
k AS (SELECT d.doc_id, string_agg(substr(h, 2 * from_ - 1, 2 * (a - from_)) || CASE WHEN last THEN substr(h, 2 * z - 1) ELSE '' END, '' ORDER BY a) AS kept, sum(z - a)::BIGINT AS gone, count(*) AS spans FROM g JOIN d ON d.doc_id = g.doc_id GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), least=30, top=2000)


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, range(1, 5) x(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, ws FROM f WHERE k > 1),
s AS (SELECT c.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS phrase, max(f) AS f FROM f, range(2, 4) y(m), LATERAL (SELECT unnest(range(1, k - m + 2)) AS j) WHERE k > m GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 80 * a QUALIFY rank <= 2000"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_feistel_pseudonyms": op2_feistel_pseudonyms,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_toxicity": op4_toxicity,
        "op5_quality_knn": op5_quality_knn,
        "op6_mixing": op6_mixing,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_html_extraction": op8_html_extraction,
        "op9_decontamination": op9_decontamination,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_collocations": op11_collocations,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_best_fit_packing": op13_best_fit_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op6_mixing": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op10_suffix_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL}
