"""Versions of payloads, exact snippets, ranking from stored statistics, aliases, recovered rows and plans of runs."""

import pytest
from pyspark.sql import functions as F

from tracelake.functions import decoding
from tracelake.functions.fold import folded_map
from tracelake.mappings import identity, recovery, registry
from tracelake.operators import planning, search


def test_two_versions_give_one_row_type(spark):
    rows = [(1, '{"name":"A","phones":"1","x":2}'), (2, '{"display_name":"A","phones":[{"value":"1"}],"deleted":true}'), (2, '{"display_name":{"a":1},"deleted":"perhaps"}'), (3, "{}"), (1, "nothing"), (1, None), (None, "{}")]
    out = decoding.decoded(spark.createDataFrame(rows, "version int, payload string"), "contact").collect()
    assert [tuple(r)[2:] for r in out] == [
        ("A", "1", None, None, "ok", [], '{"x":"2"}'), ("A", "1", None, True, "ok", [], None), ('{"a":1}', None, None, None, "ok", ["deleted"], None),
        (None,) * 4 + ("unknown-version", None, None), (None,) * 4 + ("not-an-object", None, None), (None,) * 4 + ("not-an-object", None, None), (None,) * 4 + ("unknown-version", None, None),
    ]
    assert {k for k, _ in decoding.VERSIONS} == set(decoding.FIELDS) == set(registry.TYPES)
    with pytest.raises(ValueError):
        decoding.register_version("call", 1, {})
    with pytest.raises(ValueError):
        decoding.register_version("call", 7, {"nothing": "$.x"})


@pytest.mark.parametrize(
    "text, needle, found",
    [
        ("a Straße here", "strasse", "Straße"), ("x café y", "cafe", "café"), ("the ẹ́clair", "eclair", "ẹ́clair"), ("my ﬁne day", "fine", "ﬁne"), ("ÉTÉ", "éte", "ÉTÉ"),
        ("plain words", "WORDS", "words"), ("ẞ", "s", "ẞ"), ("none", "else", None), (None, "x", None), ("", "x", None),
    ],
)
def test_snippets_in_original_characters(spark, text, needle, found):
    long = None if text is None else "́ß" * 40 + text + "ß " * 60
    row = spark.createDataFrame([(long,)], "t string").select(search.exact_snippet(F.col("t"), needle, 40).alias("x")).first()["x"]
    if found is None:
        assert row is None
        return
    first = row["spans"][0]
    assert len(row["text"]) == 40 and row["text"][first["start"] : first["start"] + first["length"]] == found if needle != "s" else row["spans"]


def test_map_of_positions():
    assert folded_map("ßéﬁ") == [("s", 0), ("s", 0), ("e", 1), ("f", 3), ("i", 3)]


def test_rank_reads_its_terms_alone(spark, tmp_path):
    recs = spark.createDataFrame([(i, f"w{i % 7} common" if i % 3 else "common", f"w{i % 11} body " * (i % 5)) for i in range(1, 400)], "id long, summary string, body string")
    search.build_index(recs, str(tmp_path), 100)
    index = search.read_index(spark, str(tmp_path))
    for weights in (search.WEIGHTS, {"body": 1.5}):
        one = [(r["id"], round(r["score"], 9)) for r in search.ranked(index, ["w3", "body"], 20, weights).collect()]
        two = [(r["id"], round(r["score"], 9)) for r in search.ranked_stored(spark, str(tmp_path), ["w3", "body"], 20, weights).collect()]
        assert one == two and one
    plan = search.ranked_stored(spark, str(tmp_path), ["w3", "body"], 20)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [body,w3])" in plan


def test_states_of_aliases(spark):
    jid = spark.createDataFrame([(1, "a@lid"), (2, "b@lid"), (3, "c@lid"), (4, "d@lid"), (5, "u@s"), (6, "e@lid"), (7, "e@lid"), (8, None)], "_id long, raw_string string")
    table = spark.createDataFrame([(1, 5), (3, 8), (4, 5), (4, 6)], "lid_row_id long, jid_row_id long")
    rows = spark.createDataFrame([("a@lid",), ("b@lid",), ("c@lid",), ("d@lid",), ("e@lid",), ("f@lid",), ("u@s",), (None,)], "address string")
    t = {"jid": jid, "jid_map": table}
    got = {r["address"]: r["x"] and (r["x"]["state"], r["x"]["pn"]) for r in identity.resolved(rows, "address", t, "x").collect()}
    assert got == {"a@lid": ("mapped", "u@s"), "b@lid": ("unmapped", None), "c@lid": ("unresolved", None), "d@lid": ("ambiguous", None), "e@lid": ("ambiguous", None), "f@lid": ("unmapped", None), "u@s": None, None: None}
    unread = jid.withColumn("_unknown", F.when(F.col("_id") == 8, F.create_map(F.lit("raw_string"), F.lit("unread"))))
    states = {r["x"]["state"] for r in identity.resolved(rows.where("address = 'f@lid'"), "address", {**t, "jid": unread.where("_id <> 7").withColumn("raw_string", F.coalesce("raw_string", F.lit("?@lid")))}, "x").collect()}
    assert states == {"undecided"}
    assert identity.resolved(rows, "address", {"jid": jid}, "x").where("x IS NOT NULL").count() == 0


def test_recovered_rows_are_never_live(spark):
    calls = spark.createDataFrame([(1, "x", 1_600_000_000_000, 5, 1)], "_id long, number string, date long, duration long, type int")
    rows = spark.createDataFrame([(7, "y", "freelist", "schema", "absent-from-live", "p=1"), (8, "z", "wal-prior", "schema", "live", "p=2"), (9, "z", "wal-prior", "schema", "unknown", "p=3")], "_id long, number string, _method string, _basis string, _relation string, _locator string")
    p = registry.PARSERS["android.calllog"]
    out = {r["rowid"]: r for r in recovery.live_and_recovered(p, {"calls": calls}, "calls", rows).collect()}
    assert {k: (r["parser"], r["confidence"]) for k, r in out.items()} == {1: ("android.calllog", None), 7: ("android.calllog.recover", 60), 9: ("android.calllog.recover", 40)}
    assert '"unknown_columns":{"date":"omitted","duration":"omitted","type":"omitted"}' in out[7]["payload"] and "unknown_columns" not in out[1]["payload"]
    assert [tuple(r) for r in recovery.recovered(p, {"calls": calls}, "calls", rows)[1].collect()] == [("the row is live", 1)]


def test_states_of_bundles(spark):
    files = spark.createDataFrame([(1, 1, "/a", "s1", False), (2, 1, "/a-wal", "s2", False), (3, 2, "/a", "s3", False), (4, 3, "/a", "s4", False), (5, 3, "/a-wal", "s5", False), (6, 3, "/a-wal", "s6", False), (7, 4, "/a", "s7", True), (8, 5, "/a", "s8", False)], "artifact long, acquisition long, path string, sha256 string, encrypted boolean")
    parser = F.when(F.col("path") == "/a", "p")
    now = planning.bundles(files, parser)
    digest = {r["artifact"]: r["digest"] for r in now.collect()}
    runs = spark.createDataFrame([("p", "v1", 1, digest[1], 1), ("p", "v1", 2, digest[1], 1), ("p", "v1", 3, "other", 1), ("p", "v0", 8, digest[8], 1)], "parser string, identity string, artifact long, digest string, run int")
    got = {r["artifact"]: (r["status"], r["reason"]) for r in planning.jobs(now, runs, {"p": "v1"}).collect()}
    assert got == {1: ("already-parsed", None), 3: ("stale-bundle", "another bundle than was parsed"), 4: ("unparsed", "ambiguous companion: wal"), 7: ("unparsed", "encrypted"), 8: ("new", None)}
    half = {r["artifact"]: r["reason"] for r in planning.jobs(now, runs.where("artifact <> 2"), {"p": "v1"}).collect()}
    assert half[1] == "not covered by an earlier run: 2"
