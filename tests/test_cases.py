import pytest
from pyspark.sql import functions as F

from tracelake.functions.payloads import Field
from tracelake.mappings import registry
from tracelake.operators import versions
from tracelake.sources import manifest, sink


def test_ingest_rejects_aborts_and_shows_what_a_crash_leaves(spark, tmp_path):
    path = str(tmp_path)
    recs = spark.createDataFrame([(i, "t", i % 4) for i in range(1, 101)], "id bigint, type string, v int")
    wrong = F.when(F.col("v") == 3, "three")
    assert tuple(sink.ingest(recs, path, "a", wrong, ["id", "v"], 10).first()) == ("a", "complete", 75, 25, 10)
    assert tuple(sink.ingest(recs, path, "b", F.lit("all"), ["id", "v"], 10).first()) == ("b", "aborted", 0, 100, 0)
    assert spark.read.parquet(f"{path}/records").count() == 75 and spark.read.parquet(f"{path}/rejected").select("_wrong").distinct().count() == 1
    spark.createDataFrame([("start",)], "kind string").write.json(f"{path}/audit/ingest_id=c")
    assert [r[0] for r in sink.interrupted(spark, path).collect()] == ["c"]


def test_types_and_hashes():
    with pytest.raises(ValueError):
        registry.register_type("message", (Field("x"),))
    hashes = {registry.parser_hash(p) for p in registry.PARSERS.values()}
    assert len(hashes) == len(registry.PARSERS) and all(t in registry.TYPES for p in registry.PARSERS.values() for t in p.emits)


def test_views_of_a_file_without_commits_and_of_new_pages(spark):
    base = spark.createDataFrame([("f", 1, "b1"), ("f", 2, "b2"), ("g", 1, "c1")], "file string, page int, content string")
    frames = spark.createDataFrame([("f", 1, 1, "x", True), ("f", 1, 2, "y", False), ("f", 3, 3, "z", False), ("g", 1, 1, "w", False)], "file string, page int, seq int, content string, commits boolean")
    got = {(r["file"], r["page"]): (r["as_found"], r["live"], r["versions"]) for r in versions.views(base, frames).collect()}
    assert got == {("f", 1): ("y", "x", 2), ("f", 2): ("b2", "b2", 0), ("f", 3): ("z", None, 1), ("g", 1): ("w", "c1", 1)}


def test_manifest_states(spark):
    good = '{"id":"a","path":"p","sha256":"' + "0" * 64 + '","size":1,"kind":"file"}'
    lines = [good, good[:-1], good.replace('"size":1', '"size":-1'), good.replace('"kind"', '"sort"'), good.replace('"size":1,', ""), good.replace('{"id":"a"', '{"id":"a","id":"b"'), "[]", None]
    got = manifest.parsed(spark.createDataFrame([(x,) for x in lines], "line string"), "line").select("state").collect()
    assert [r[0] for r in got] == ["ok", "not-json", "bad-value", "unknown-key", "missing", "repeated-key", "not-json", "not-json"]
