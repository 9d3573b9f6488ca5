import pytest
from pyspark.sql import functions as F

from tracelake.mappings import registry
from tracelake.operators import carve, reconcile
from tracelake.plans import apps, mapped
from tracelake.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_probe_tells_absent_from_unsupported(spark):
    p = registry.PARSERS["android.calllog"]
    calls = spark.createDataFrame([(1, "x", 0, 0, 1)], "_id long, number string, date long, duration long, type int")
    assert registry.probe(p, {}) == "not-applicable"
    assert registry.probe(p, {"calls": calls.drop("type")}) == "unsupported-schema"
    assert registry.probe(p, {"calls": calls}) == "applicable"
    with pytest.raises(ValueError):
        registry.records(p, {})
    assert [r["ts"] for r in registry.records(p, {"calls": calls}).collect()] == [None]  # a sentinel is no time


def test_every_mapping_gives_records(spark):
    for p in registry.PARSERS.values():
        tables = {n: mapped.app_table(spark, "/root/testdata/sf0.001", apps.PREFIX.get(p.name, "") + n) for n in p.needs}
        out = registry.records(p, tables)
        assert out.columns == ["parser", "type", "rowid", "ts", "payload"] and out.count() > 0
        empty = registry.records(p, {n: t.limit(0) for n, t in tables.items()})
        assert empty.count() == 0


def test_joins_keep_three_outcomes(spark):
    sms = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, None, "a"), (4, 9, "a")], "_id long, thread_id long, address string").select("*", F.lit(0).alias("date"), F.lit(1).alias("type"), F.lit("").alias("body"))
    threads = spark.createDataFrame([(1, "1 1"), (2, "1 x 5")], "_id long, recipient_ids string")
    addresses = spark.createDataFrame([(1, "+1")], "_id long, address string")
    out = registry.PARSERS["android.sms"].run({"sms": sms, "threads": threads, "canonical_addresses": addresses})
    assert rows(out, "rowid", "members", "thread_state") == [(1, "+1", "found"), (2, "+1", "partial"), (3, None, "none"), (4, None, "unresolved")]


def test_ambiguous_key_takes_no_value(spark):
    visits = spark.createDataFrame([(1, 5, 13_300_000_000_000_000, 0x20000001)], "id long, url long, visit_time long, transition long")
    urls = spark.createDataFrame([(5, "u", "t", 0), (5, "v", "t", 0)], "id long, url string, title string, last_visit_time long")
    out = registry.PARSERS["chromium.history"].run({"visits": visits, "urls": urls})
    assert rows(out, "url", "url_state", "core", "qualifiers") == [(None, "ambiguous", "typed", "chain_end")]


def test_carving_equals_a_plain_search(spark):
    sig = carve.Signature("x", b"\xff\xd8", b"\xff\xd9", 12)
    blobs = [b"", None, b"..\xff\xd8ab\xff\xd9..", b"\xff\xd8\xff\xd9\xff\xd8", b"\xff\xd8" + b"." * 20 + b"\xff\xd9", b"\xff\xd8a\xff\xd8b\xff\xd9z\xff\xd9"]
    want = []
    for i, b in enumerate(blobs):
        starts = [k for k in range(len(b or b"")) if b[k : k + 2] == sig.header]
        for k, nxt in zip(starts, [*starts[1:], None]):
            end = b.find(sig.footer, k + 2, nxt)
            if end >= 0 and end + 2 - k <= 12:
                want.append((i, "x", k, end + 2 - k))
    df = spark.createDataFrame(list(enumerate(blobs)), "k int, b binary")
    assert rows(carve.carve(df, "k", "b", (sig,)), "k", "signature", "start", "size") == sorted(want, key=repr)
    assert carve.carve(df, "k", "b").count() == 0


def test_audit_chain_finds_each_kind_of_break(spark):
    import hashlib

    entries, before = [], ""
    for i in range(1, 9):
        digest = hashlib.sha256(f"{before}|e{i}".encode()).hexdigest()
        entries.append(["c", i, f"e{i}", before, digest])
        before = digest
    entries[2][2] = "changed"  # 3 altered
    entries[4][3] = "other"  # 5 unlinked
    del entries[6]  # 8 after a gap
    entries.append(entries[0])
    log = spark.createDataFrame([tuple(e) for e in entries], "k string, seq int, entry string, prev string, digest string")
    got = rows(reconcile.audit_chain(log, "k", "seq", "prev", "digest", ["prev", "entry"]), "seq", "state")
    assert got == [(1, "repeated"), (3, "altered"), (5, "unlinked"), (8, "gap")]


def test_ranges_do_not_overflow(spark):
    ranges = spark.createDataFrame([("a", 0, 10), ("a", 5, (1 << 63) - 1), ("a", -1, 2), ("b", 0, 0)], "k string, offset long, length long")
    sizes = spark.createDataFrame([("a", 10)], "k string, size long")
    assert len(rows(reconcile.outside(ranges, sizes, "k"), "k", "offset")) == 3


def test_stream_appends_each_record_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows_ = spark.range(1, 101).select("id", F.lit("t").alias("type"), (F.col("id") * 86_400_000_000).alias("ts"))
    rows_.where("id <= 60").write.parquet(src)
    schema = rows_.schema
    ingest.ingest(spark.readStream.schema(schema).parquet(src), out, state).awaitTermination(120)
    rows_.where("id > 60").write.mode("append").parquet(src)
    ingest.ingest(spark.readStream.schema(schema).parquet(src), out, state).awaitTermination(120)
    ingest.ingest(spark.readStream.schema(schema).parquet(src), out, state).awaitTermination(120)
    got = ingest.batches(spark, out, ["id", "type", "ts"]).collect()
    assert sum(r["n"] for r in got) == 100 and len(got) == 2
    counts = ingest.event_counts(spark.read.parquet(src))
    assert counts.count() == 100
