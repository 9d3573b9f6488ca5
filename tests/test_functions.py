import pytest
from pyspark.sql import functions as F

from tracelake.functions import cells, texts
from tracelake.functions import values as V
from tracelake.sources import sink

CELL = "c struct<i: bigint, r: double, t: string, b: binary>"


def column(spark, values, kind, make):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r["out"] for r in df.withColumn("out", make(F.col("v"))).orderBy("n").collect()]


def cells_of(spark, values):
    rows = [({"i": v if isinstance(v, int) else None, "r": v if isinstance(v, float) else None, "t": v if isinstance(v, str) else None, "b": v if isinstance(v, bytes) else None},) for v in values]
    return spark.createDataFrame(rows, CELL)


def test_numbers_sort_exactly(spark):
    want = [None, float("-inf"), -1, -0.5, 0, 2, 2.5, (1 << 53), (1 << 53) + 1, (1 << 63) - 1, 9.3e18, "", "A", "a", b"", b"\0"]
    out = cells_of(spark, want[::-1]).orderBy(cells.order_key(F.col("c"))).collect()
    got = [next((x for x in r["c"] if x is not None), None) for r in out]
    assert [bytes(x) if isinstance(x, bytearray) else x for x in got] == want


def test_equality_keys(spark):
    keys = [r["k"] for r in cells_of(spark, [1, 1.0, "1", b"1", 1.5, None, float("nan")]).select(cells.equality_key(F.col("c")).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys[:5])) == 4 and keys[5:] == [None, None]


def test_text_that_meets_a_number(spark):
    out = column(spark, ["7", " -7 ", "1.5", "1e3", "1e40", "1e99999999999", "1234567890123456789012", "0.1234567890123456", "x", "", ".", None], "string", cells.as_number)
    assert [r["state"] for r in out] == ["exact"] * 4 + ["undecided"] * 4 + ["text"] * 3 + [None]
    assert (out[1]["i"], out[2]["r"], out[3]["r"]) == (-7, 1.5, 1000.0)


def test_durations(spark):
    out = column(spark, ["P1W", "-PT1H30M", "P3600S", "P", "PT", "P1X", "P1D1D", "P1234567890S", "P999999999W", None], "string", texts.duration_seconds)
    assert [r["seconds"] for r in out] == [604800, -5400, 3600] + [None] * 7
    assert [r["state"] for r in out] == ["ok"] * 3 + ["unparsed"] * 4 + ["too-long", "out-of-range", None]


def test_dates_labels_and_summaries(spark):
    assert column(spark, ["2024-02-29", "2023-02-29", "--02-29", "--13-01", "x"], "string", texts.real_date) == [True, False, True, False, False]
    assert column(spark, ["_$!<Home>!$_", "Home"], "string", texts.unwrap_label) == ["Home", "Home"]
    guid = "01234567-89AB-cdef-0123-456789abcdef"
    assert column(spark, [f"p:0/{guid}", f"bp:{guid}", guid, "p:0/x"], "string", texts.target_guid) == [guid, guid, guid, None]
    assert column(spark, ["a \n\t b", "x" * 20, None], "string", lambda c: texts.summary(c, 10)) == ["a b", "xxxxxxx...", None]
    assert column(spark, ["validated", "footer", "bounded", "?"], "string", texts.carve_confidence) == [70, 50, 25, None]


@pytest.mark.parametrize("make, values, want", [
    (texts.cocoa_us, [0.0, -1.0, float("nan"), float("inf"), 1e12, 0.5], [None] * 5 + [V.COCOA * 1_000_000 + 500_000]),
])
def test_cocoa(spark, make, values, want):
    assert column(spark, values, "double", make) == want


def test_integer_times_are_exact(spark):
    ns = 1_700_000_000_123_456_789
    assert column(spark, [ns, 999, 0, -(1 << 63)], "long", lambda c: V.unix_us(c, "ns")) == [ns // 1000, 0, None, None]
    assert column(spark, [(1_700_000_000_123_456 - V.WEBKIT * 1_000_000) * 10 + 9, 0], "long", texts.filetime_us) == [1_700_000_000_123_456, None]
    assert column(spark, [1_700_000_000, 1_700_000_000_000], "long", texts.guarded_ms_us) == [None, 1_700_000_000_000_000]


def test_append_is_repeatable(spark, tmp_path):
    recs = spark.range(1, 11).select("id", F.when(F.col("id") > 5, "a").otherwise("b").alias("type"))
    one = sink.append(recs, str(tmp_path), "r1", ["id", "type"], 4).orderBy("batch_no").collect()
    two = sink.append(recs.repartition(3), str(tmp_path), "r1", ["id", "type"], 4).orderBy("batch_no").collect()
    assert one == two and [r["n"] for r in one] == [4, 4, 2]
    assert spark.read.parquet(f"{tmp_path}/records").count() == 10
    stored = spark.createDataFrame([(0,), (9,)], "batch_no long")
    left = sink.unresolved(spark.createDataFrame([r["batch_no"] for r in one], "long").toDF("batch_no"), stored, ["batch_no"])
    assert {tuple(r) for r in left.collect()} == {(1, "not stored"), (2, "not stored"), (9, "not audited")}
