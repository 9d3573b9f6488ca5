import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracelake.functions import fold
from tracelake.operators import search
from tracelake.operators.search import item


def records(spark, bodies):
    return spark.createDataFrame([(i + 1, f"s{i % 2}", b) for i, b in enumerate(bodies)], "id bigint, summary string, body string")


@pytest.mark.parametrize(
    "text, want",
    [
        ("ﬁne  Straße\x00x", "fine strasse x"), ("a​b‍c­d", "a bcd"), ("İSTANBUL ısı", "istanbul isi"), ("Ａ１", "a1"), ("日本語 text", "日 本 語 text"), ("か゛な", "か ゙な"),
        ("ᎠꭰᏸᏰ", "ꭰꭰᏸᏸ"), ("x️y", "xy"), (None, ""), (" \t\n", ""), ("한국어 คน", "한국어 คน"),
    ],
)
def test_normalise(text, want):
    assert fold.normalise(text) == unicodedata.normalize("NFKC", want)


def test_normalise_is_idempotent_and_clean():
    rnd = random.Random(5)
    for _ in range(2000):
        t = "".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0x300, 0x3100), rnd.randrange(0x4E00, 0x5000), rnd.randrange(0x13A0, 0x1400), rnd.randrange(0xAB70, 0xABC0)])) for _ in range(8))
        n = fold.normalise(t)
        assert fold.normalise(n) == n and "  " not in n and n == n.strip() and not any(unicodedata.category(c) in ("Cc", "Cf") for c in n)


def test_folding_and_words_beyond_latin_1(spark):
    texts = ["ấmẹ Łódź ñandú", "Ἀθήνα ёлка", "a⃝b e᷉x", "co-op don't 3½ x²", "naïve", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fold.folded(F.col("t")).alias("f"), fold.tokens(F.col("t")).alias("w")).collect()
    assert [r["f"] for r in got] == [fold.fold(t or "") for t in texts]
    # A stroke is no accent, and accents of other scripts stay; marks outside the fixed list separate words.
    assert got[0]["w"] == ["ame", "łodz", "nandu"] and got[1]["w"] == ["ἀθήνα", "ёлка"] and got[2]["w"] == ["a", "b", "e", "x"] and got[3]["w"] == ["co", "op", "don", "t", "3½", "x²"]
    assert fold.words("Łódź, CO-OP!") == ("łodz", "co", "op")


def test_trigrams(spark):
    row = spark.createDataFrame([("Über",), ("ab",), (None,)], "t string").select(fold.trigrams(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in row] == [["ube", "ber"], [], []]


def test_groups_against_brute_force(spark):
    rnd = random.Random(6)
    letters = ["ana", "bob", "anab", "cy", "dé"]
    bodies = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 6))) or None for _ in range(150)]
    recs = records(spark, bodies)
    index = search.postings(recs).cache()

    def has(text, i):
        w = fold.words(text or "")
        n = len(i.words)
        return any(w[k : k + n - 1] == i.words[:-1] and (w[k + n - 1].startswith(i.words[-1]) if i.prefix else w[k + n - 1] == i.words[-1]) for k in range(len(w) - n + 1))

    for _ in range(12):
        groups = [[item(" ".join(rnd.choice(letters) for _ in range(rnd.randint(1, 2))), prefix=rnd.random() < 0.3 and True, negative=k > 0 and rnd.random() < 0.5) if rnd.random() < 1 else None for k in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 2))]
        want = [i + 1 for i, b in enumerate(bodies) if any(all(has(b, x) != x.negative for x in g) for g in groups)]
        assert sorted(r["id"] for r in search.matching(recs, index, groups, ("body",)).collect()) == want, groups


def test_limits():
    for bad in (lambda: item("..."), lambda: item("x", prefix=True), lambda: item("a" * 300), lambda: search.checked([[item("a", negative=True)]]), lambda: search.checked([[item("a")] * 65]), lambda: search.checked([])):
        with pytest.raises(search.InvalidQuery):
            bad()
    assert search.quoted("a\x1b[2J" + "é" * 40).isascii() and search.quoted("ab") == '"ab"'


def test_index_is_built_in_chunks_and_resumed(spark, tmp_path):
    path = str(tmp_path / "index")
    recs = records(spark, [f"word{i} common" for i in range(40)])
    assert search.index_state(recs, path) == "unbuilt"
    search.build_index(recs, path, 10, only=[0, 2])
    assert search.index_state(recs, path) == "building"
    assert search.reindex(recs, path, 10) == [1, 3] and search.index_state(recs, path) == "current"
    assert search.reindex(recs, path, 10) == [] and search.read_index(spark, path).count() == 120
    proof = {r["batch_no"]: r["state"] for r in search.index_proof(search.read_index(spark, path).where("id != 15 AND id < 31"), recs, "k", 10).collect()}
    assert proof == {0: "equal", 1: "differs", 2: "equal", 3: "missing"}
    spark.createDataFrame([("old", 10)], "version string, chunk_rows long").write.mode("overwrite").parquet(f"{path}/state")
    assert search.index_state(recs, path) == "stale" and search.reindex(recs, path, 10) == [0, 1, 2, 3]


def test_rank_against_the_formula(spark):
    import math

    bodies = ["a b", "a a b c", "b c d e f g h", "a b a", None, "c", "x y", "z", "q r", "d"]
    recs = records(spark, bodies)
    got = [(r["id"], r["score"]) for r in search.ranked(search.postings(recs), ["A", "b"], 10).collect()]
    docs = [[f"s{i % 2}"] + (b or "").split() for i, b in enumerate(bodies)]
    avg = sum(map(len, docs)) / len(docs)
    want = []
    for i, d in enumerate(docs):
        if {"a", "b"} <= set(d):
            score = 0.0
            for t in ("a", "b"):
                df = sum(t in x for x in docs)
                score -= max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg))
            want.append((score, i + 1))
    assert [i for i, _ in got] == [i for _, i in sorted(want)] and all(abs(s - w) < 1e-9 for (_, s), (w, _) in zip(got, sorted(want), strict=True))


def test_snippets_show_where_hits_are(spark):
    df = spark.createDataFrame([("x" * 50 + " Éa ea " + "y" * 50,), ("none",), (None,)], "t string").select(search.snippet(F.col("t"), "ea", 24).alias("s"))
    one, two, three = (r["s"] for r in df.collect())
    assert two is None and three is None and [one["text"][k : k + 2] for k in one["at"]] == ["Éa", "ea"] and len(one["text"]) == 24
