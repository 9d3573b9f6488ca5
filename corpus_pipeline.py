"""From raw documents to a training mix: five stages, each over all that its predecessor kept.

The stages call their operators with columns c0, c1 ... for the table's own, so that columns of any names come through;
all but the last give the columns of documents back, in order. Defined cases, for every stage: rows of null or repeated
ids are apart; null and empty texts fail the quality rules, and where they come in are kept by the later stages; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, jaccard_join, mixing, pii, quality_rules
from tracelake.llm.common import drop_tables, row_keys, scratch, stage_table, table

MAX_BROADCAST_IDS = 2_000_000


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1 ..., and which of these each column is."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def good_hosts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and their host's verdict."""
    rows, c = plain(docs)
    return back(quality_rules.host_verdicts(rows, text=c["text"], host=c["source"]).where("_kept"), c)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by id and text, of each group of near duplicates (five words, Jaccard 0.8).

    Rows of an id with different texts are apart. Texts without words link with nothing and stay, but of repeated rows of such
    a text under one id the first stays alone.
    """
    rows, c = plain(docs)
    keyed, numbered = row_keys(rows, c["doc_id"], c["text"], "pipeline-rows", "_row")
    found = stage_table(jaccard_join.join_documents(keyed, size=5, pct=80, doc_id="_row", text=c["text"]), "pipeline-components")
    gone = found.where("_row != component_id").select("_row")
    if numbered:
        bare = keyed.join(found.where("n_shingles = 0").select("_row"), "_row", "left_semi").where(F.col(c["doc_id"]).isNotNull())
        first = bare.groupBy(c["doc_id"], c["text"]).agg(F.min("_row").alias("_row"))
        gone = gone.union(bare.select("_row").join(first.select("_row"), "_row", "left_anti"))
    # So many keys fit in every executor's memory; beyond that the texts are shuffled.
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    return back(keyed.join(gone, "_row", "left_anti"), c)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    rows, c = plain(docs)
    return back(decontaminate.find(rows, table(spark, sf_dir, "benchmark"), text=c["text"]).where(F.size("_matches") == 0), c)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    rows, c = plain(docs)
    out = pii.pseudonymise(rows, text=c["text"])
    return back(out, c) if "n_chars" not in c else back(out.withColumn(c["n_chars"], F.length(c["text"]).cast(docs.schema["n_chars"].dataType)), c)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text and how many of its words the mix takes, repeats counted."""
    rows, c = plain(docs)
    return mixing.mix(rows, doc_id=c["doc_id"], text=c["text"], source=c["source"], keep=(c["text"],)).withColumnRenamed(c["text"], "text")


STAGES = [
    ("quality rules", good_hosts),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("PII", pseudonymised),
    ("mixing sources to target weights", mixed),
]

#: Three stages have no SQL form; tests/llm/test_pipeline.py compares run() with a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of documents, as a table of its own: ``release`` deletes it once it has been used. No other table is left."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        with scratch(spark):
            docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}", kept=True)
        if last is not None:
            drop_tables(last)
        last = docs
    return docs


def release(mix: DataFrame) -> None:
    """Deletes the table of a mix that run gave."""
    drop_tables(mix)
