"""Cells that aren't known, through lookups, child tables, marks, anti joins and payloads."""

import json

from pyspark.sql import functions as F

from tracelake.mappings import joins, registry


def unread(df, **gaps):
    """df with cells unread where conditions hold."""
    names = F.map_from_entries(F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("k"), F.lit("unread").alias("v"))) for n, c in gaps.items()]), lambda x: x.isNotNull()))
    return df.select(*[F.when(~F.expr(gaps[n]), F.col(n)).alias(n) if n in gaps else F.col(n) for n in df.columns], names.alias("_unknown"))


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_lookup(spark):
    rows = frame(spark, "id long, k long", (1, 10), (2, 20), (3, None), (4, 40), (5, 50))
    other = frame(spark, "k long, v string", (10, "a"), (20, "b"), (20, "c"), (60, "d"))
    plain = {r["id"]: (r["w"], r["x_state"]) for r in joins.lookup(rows, "k", other, "k", {"w": "v"}, "x_state").collect()}
    assert plain == {1: ("a", "found"), 2: (None, "ambiguous"), 3: (None, "none"), 4: (None, "unresolved"), 5: (None, "unresolved")}
    assert joins.carried(joins.lookup(rows, "k", other, "k", {"w": "v"}, "x_state")) == []
    out = joins.lookup(unread(rows, k="id = 5"), "k", unread(other, k="v = 'd'", v="v = 'a'"), "k", {"w": "v"}, "x_state")
    got = {r["id"]: (r["w"], r["x_state"], r["_joined_unknown"], r["_undecided"], r["_short"]) for r in out.collect()}
    assert got == {1: (None, "found", {"x.v": "unread"}, [], ["x"]), 2: (None, "ambiguous", {}, [], ["x"]), 3: (None, "none", {}, [], []), 4: (None, "undecided", {}, ["x"], []), 5: (None, "undecided", {}, ["x"], [])}


def test_children(spark):
    rows = frame(spark, "id long", (1,), (2,), (3,))
    child = frame(spark, "parent long, v string", (1, "a"), (1, "b"), (2, "c"), (9, "d"))
    values = {"vs": joins.listed(F.col("v")), "n": F.count("*")}
    plain = {r["id"]: (r["vs"], r["n"]) for r in joins.children(rows, "id", child, "parent", "child", values, ("v",), ("n",)).collect()}
    assert plain == {1: ("a,b", 2), 2: ("c", 1), 3: (None, 0)}
    lost = joins.children(rows, "id", unread(child, parent="v = 'd'", v="v IN ('b', 'c')"), "parent", "child", values, ("v",), ("n",))
    got = {r["id"]: (r["vs"], r["n"], r["_undecided"], r["_short"]) for r in lost.collect()}
    assert got == {1: ("a", 2, [], ["child"]), 2: (None, 1, [], ["child"]), 3: (None, None, ["child"], [])}


def test_marks_and_absence(spark):
    rows = frame(spark, "id long", (1,), (2,), (3,))
    other = frame(spark, "k long, z int", (1, 0), (7, 1))
    assert {r["id"]: r["m"] for r in joins.marked(rows, "id", other, "k", "other", "m").collect()} == {1: True, 2: False, 3: False}
    assert {r["id"]: r["m"] for r in joins.marked(rows, "id", unread(other, k="z = 1"), "k", "other", "m").collect()} == {1: True, 2: None, 3: None}
    assert sorted(r["id"] for r in joins.absent(rows, "id", other, "k", "other").collect()) == [2, 3]
    out = joins.absent(unread(rows, id="id = 3"), "id", other, "k", "other").collect()
    assert sorted((str(r["id"]), r["_undecided"]) for r in out) == [("2", []), ("None", ["other"])]


def test_payloads_name_what_is_not_known(spark):
    sms = unread(frame(spark, "_id long, thread_id long, address string, date long, type int, body string", (1, 1, "+1", 10**12, 1, "a"), (2, 2, "+2", 10**12, 2, "b"), (3, 9, "+3", 10**12, 1, "c")), body="_id = 1", thread_id="_id = 2")
    threads = unread(frame(spark, "_id long, recipient_ids string", (1, "1"), (5, "1 2")), recipient_ids="_id = 5")
    addresses = frame(spark, "_id long, address string", (1, "+1"))
    out = {r["rowid"]: json.loads(r["payload"]) for r in registry.records(registry.PARSERS["android.sms"], {"sms": sms, "threads": threads, "canonical_addresses": addresses}).collect()}
    assert out[1]["unknown_columns"] == {"body": "unread"} and "body" not in out[1] and out[1]["members"] == "+1" and out[1]["join_short"] == ["thread"]
    assert out[2]["thread_state"] == "undecided" and out[2]["join_undecided"] == ["thread"] and "members" not in out[2]
    assert out[3]["thread_state"] == "undecided" and out[3]["join_undecided"] == ["thread"]
    known = registry.records(registry.PARSERS["android.sms"], {"sms": sms.drop("_unknown"), "threads": threads.drop("_unknown"), "canonical_addresses": addresses}).collect()
    assert not any("unknown" in r["payload"] or "undecided" in r["payload"] for r in known)


def test_probe_states(spark):
    p = registry.PARSERS["android.contacts"]
    t = {n: frame(spark, ", ".join(f"{c} string" for c in cols)) for n, cols in p.needs.items()}
    assert registry.probe(p, t) == "applicable" and registry.probe(p, {}, 7.95) == "encrypted" and registry.probe(p, {}, 5.0) == "not-applicable"
    assert registry.probe(p, {"data": t["data"]}) == "unsupported-schema" and registry.probe(p, {"data": t["data"]}, companions=True) == "deferred"
    assert registry.probe(p, {**t, "accounts": frame(spark, "_id long")}) == "unsupported-schema"
    assert len({registry.parser_hash(x) for x in registry.PARSERS.values()}) == len(registry.PARSERS)
