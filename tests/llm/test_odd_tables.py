"""All operators over tables with clashing columns, null and repeated ids, repeated rows, ties, very long texts, and none at all."""

import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat, decontaminate, html_extract, jaccard_join, mixing, pii, quality_knn, quality_rules, suffix_dedup, toxicity

#: Every name that an operator gives a column of its own, besides those of documents.
CLASHES = (
    "_q", "_base_failed", "_grave", "_mild", "_host", "_host_rate", "_kept", "_pii", "_pii_found", "_layout", "_turns", "_chat", "_formatted", "_loss", "_score", "_features",
    "_digest", "_row", "_doc", "_data", "_id", "_text", "_main_text", "_matches", "_size", "_shard", "_block", "_quota", "_source", "_order", "_end", "h", "seg", "token", "n", "g", "label", "size", "target", "taken", "component_id", "n_shingles", "n_bytes", "kept",
)
LONG = " ".join(f"word{i % 9973}" for i in range(500_000))  # 4.8 MB


def table(spark, rows):
    base = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return base.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])


def rows():
    text = "a tie of equal words here, then a tie of equal words there, and more"
    return [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (None, "other " * 12, "en", None, 1), (5, text, "en", "a", 1), (5, "five " * 30, "de", "b", 1), (5, text, "en", "a", 1), (7, None, None, None, None), (8, "", "en", "b", 0), (9, LONG, "en", "c", len(LONG)), (10, LONG, "en", "c", len(LONG))]


def labelled(spark):
    return spark.createDataFrame([(i, ("you idiot " if i % 2 else "a fine day ") * 5, i % 2) for i in range(20)], "doc_id bigint, text string, label int")


def chats(docs):
    return chat.format_chats(docs.withColumn("record", F.to_json(F.struct(F.col("text").alias("prompt"), F.coalesce("lang", F.lit("")).alias("completion")))))


def bench(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[100:130]))], "item_id bigint, text string")


#: name -> operator over documents, its results, and whether other columns pass through.
OPERATORS = {
    "quality_rules": (lambda s, d: quality_rules.host_verdicts(d), quality_rules.RESULTS, True),
    "pii": (lambda s, d: pii.pseudonymise(d), ("_pii_found",), True),
    "chat": (lambda s, d: chats(d), chat.RESULTS, True),
    "toxicity": (lambda s, d: toxicity.score(d, toxicity.fit(labelled(s))), ("_score",), True),
    "quality_knn": (lambda s, d: quality_knn.score(d, quality_knn.fit(labelled(s))), ("_score",), True),
    "mixing": (lambda s, d: mixing.mix(d), ("doc_id", "source", "size", "source_size", "target", "taken"), False),
    "jaccard_join": (lambda s, d: jaccard_join.join_documents(d), ("doc_id", "n_shingles", "component_id"), False),
    "html_extract": (lambda s, d: html_extract.extract(d, "text"), ("_main_text",), True),
    "decontaminate": (lambda s, d: decontaminate.find(d, bench(s)), ("_matches",), True),
    "suffix_dedup": (lambda s, d: suffix_dedup.dedup(d), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept"), False),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, results, through = OPERATORS[name]
    docs = table(spark, rows())
    out = run(spark, docs)
    assert set(results) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    if through:
        assert set(CLASHES) <= set(out.columns)
        got = out.select("doc_id", *[c for c in CLASHES if c not in results]).collect()
        assert all(r[c] == f"mine {c}" for r in got for c in CLASHES if c not in results)
    else:
        got = out.select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    run, results, _ = OPERATORS[name]
    out = run(spark, table(spark, []))
    assert set(results) <= set(out.columns) and out.count() == 0


def test_repeated_rows_alike(spark):
    """Rows with the same text get the same from every operator that looks at a row alone."""
    docs = table(spark, rows())
    of = {
        "quality_rules": ["_q", "_base_failed"], "pii": ["text", "_pii_found"], "chat": ["_formatted"], "toxicity": ["_score"], "quality_knn": ["_score"], "html_extract": ["_main_text"], "decontaminate": ["_matches"],
    }
    for name, columns in of.items():
        out = OPERATORS[name][0](spark, docs.where("doc_id = 5 AND text LIKE 'a tie%'")).select(*columns).collect()
        assert len(out) == 2 and out[0] == out[1], name


def test_values_of_odd_rows(spark):
    docs = table(spark, rows())
    kept = {(r["doc_id"], r["text"] if r["text"] != LONG else "long"): (r["n"], r["f"]) for r in quality_rules.host_verdicts(docs).select("doc_id", "text", F.col("_q.n_words").alias("n"), F.col("_base_failed").alias("f")).collect()}
    assert kept[(7, None)] == (0, True) and kept[(8, "")] == (0, True) and kept[(9, "long")][0] == 500_000
    groups = {}
    for r in jaccard_join.join_documents(docs).collect():
        groups.setdefault(r["component_id"], []).append((r["doc_id"], r["n_shingles"]))
    assert sorted(i for i, _ in groups[9]) == [9, 10] and groups[7] == [(7, 0)] and groups[8] == [(8, 0)]
    assert sorted(str(i) for i, n in groups[5]) == ["5", "5", "5", "None", "None"] or sorted(str(i) for i, n in groups[5]) == ["5", "5", "None", "None"]
    matches = {r["doc_id"]: r["k"] for r in decontaminate.find(docs, bench(spark)).groupBy("doc_id").agg(F.sum(F.size("_matches")).alias("k")).collect()}
    assert matches == {None: 0, 5: 0, 7: 0, 8: 0, 9: 1, 10: 1}
    cut = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.dedup(docs).where("doc_id >= 7").collect()}
    assert cut[(7, 0)] == 0 and cut[(10, len(LONG))] == len(LONG) and 0 < cut[(9, len(LONG))] < len(LONG)
