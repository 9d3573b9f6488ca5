"""The pipeline, stage by stage and as a whole, against plain Python and SQL."""

import duckdb
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import decontaminate, pii
from tracelake.llm.queries import OP6_SQL

from . import plain

SF = "/root/testdata/sf0.001"


def run_plain(rows, items):
    """rows (doc_id, text, source) in order of ids -> the rows after each stage; the mix as (doc_id, size, source_size, target, taken)."""
    kept = [r for r, k in zip(rows, plain.quality([(t, s) for _, t, s in rows]), strict=True) if k]
    stages = [kept]
    first, _ = plain.components([t for _, t, _ in kept], 5, 80)
    kept = [r for i, r in enumerate(kept) if first[i] == i]
    stages.append(kept)
    least, most = plain.contaminated([t for _, t, _ in kept], items, decontaminate)
    assert least == most, "this data doesn't decide every match"
    kept = [r for r, hit in zip(kept, least, strict=True) if not hit]
    stages.append(kept)
    kept = [(i, regex.sub(pii.ANY, lambda m: plain.pseudonym(m.group(), pii.KEY, pii.FORMS), t), s) for i, t, s in kept]
    stages.append(kept)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(kept, columns=["doc_id", "text", "source"]))
    stages.append(sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP6_SQL})").fetchall()))
    return stages


@pytest.fixture(scope="module")
def wanted(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    return run_plain(rows, items)


def test_run(spark, wanted):
    from pathlib import Path

    from tracelake.llm.common import shared_dir

    here = Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in here.glob("*")}
    mix = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["text"] for r in mix.collect()} == {i: t for i, t, _ in wanted[-2]}
    got = sorted(tuple(r) for r in mix.select("doc_id", "size", "source_size", "target", "taken").collect())
    want = wanted[-1]
    assert len({p.name for p in here.glob("*")} - before) == 1
    corpus_pipeline.release(mix)
    assert {p.name for p in here.glob("*")} == before
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want] and len(got) > 50
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_each_stage_on_what_the_one_before_kept(spark, wanted):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, lengths = docs.columns, [len(docs.collect())]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted[:-1], strict=True):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        got = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
        assert got == sorted(want), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        lengths.append(len(got))
    assert lengths[0] > lengths[1] > lengths[2] > lengths[3] == lengths[4]


def test_columns_of_any_name_come_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["_q", "_kept", "_row", "_matches", "_pii", "_doc", "c0", "component_id", "_host", "size"]
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 60


def test_empty_table_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (3, "", "en", "a", 0), (3, None, "en", "a", None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        assert stage(spark, odd, SF).count() == (0 if name == "quality rules" else 4), name
