"""Phrases against plain counting; the index against the text."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import collocations as co

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least=30, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        longer = [p for p in f if len(p) > 2 and f[p] >= least]
        around = {}
        for p in longer:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around.get(p[i : i + k], 0), f[p])
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * around.get(p, 0) < 80 * a:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r[c] for c in COLUMNS) for r in co.mine(df, **more).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "été", "x\x00y", "ﬀ", "a" * 300, *[f"w{i}" for i in range(12)]]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice(["new york city hall", "of the", "Été indien", *rng.choices(words, k=8)]))
            out.append(rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\r\x0b"]))
        rows.append(("".join(out), rng.choice(["en", "en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("shard_words", [50, 3_000_000])
def test_against_plain_counting(spark, shard_words):
    rows = corpus(3, 400) + [(None, "en"), ("", "fr"), ("...", None), ("one", "xx")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS name", "'mine' AS shard", "'mine' AS words").repartition(6)
    got = mined(df, shard_words=shard_words)
    assert got == plain(rows) and len(got) > 10


def test_few_ranks_and_ties(spark):
    rows = [("p q. r s. t u v", "en")] * 40
    assert mined(spark.createDataFrame(rows, "text string, lang string"), top=2) == plain(rows, top=2)


def test_empty(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert mined(empty) == [] and mined(spark.createDataFrame([(None, None), ("", "en")], empty.schema)) == []


def test_slices_end_pieces(monkeypatch):
    text = ("Some words, and more. " * 50).encode()
    parts = list(co.slices(text, 64))
    assert len(parts) > 5 and all(p.endswith(b"\xff") for p in parts) and b"".join(parts).startswith(b"some words\xff and more\xff")


@pytest.mark.parametrize("seed", range(20))
def test_intervals_are_the_phrases(seed):
    """On each level: every phrase without a separator, with its count, from extensions alone."""
    rng = np.random.default_rng(seed)
    s = np.concatenate(([0], rng.integers(0, 6, 300), [0])).astype(np.int32)
    fm = co.Index(co.transform(s).astype(np.int64))
    ring = [tuple(np.roll(s, -i)[:4].tolist()) for i in range(len(s))]
    known = {(int(w),): (int(fm.first[w]), int(w)) for w in range(1, 6) if fm.counts[w]}
    for m in range(1, co.DEPTH):
        names = {v: k for k, (_, v) in known.items()}
        at, count, left, right = fm.extend(np.array([a for a, _ in known.values()]), np.array([v for _, v in known.values()]))
        got = {(*names[int(x)], names[int(y)][-1]): int(c) for c, x, y in zip(count, left, right)}
        assert got == {p: c for p, c in Counter(r[: m + 1] for r in ring).items() if 0 not in p}
        known = {(*names[int(x)], names[int(y)][-1]): (int(a), k) for k, (a, x, y) in enumerate(zip(at, left, right))}


def test_languages_apart_and_long_texts(spark):
    long = "mega word " * 200_000
    rows = [(long, "en"), ("mega word " * 29, "de"), ("mega word " * 30, "fr")]
    got = mined(spark.createDataFrame(rows, "text string, lang string"))
    assert got == plain(rows) and ("fr", "mega word") in {(r[0], r[2]) for r in got}
    assert mined(spark.createDataFrame([("mega word. " * 30, "fr")], "text string, lang string").withColumn("n", F.lit(1))) == plain([("mega word. " * 30, "fr")])


def test_waves_part_the_phrases_of_a_level(spark, monkeypatch):
    """No wave's counts are all of a level's, each phrase is in one wave, and a table keeps key and count of a phrase once."""
    rows, real, tables = corpus(5, 300), co._frequent, []

    def frequent(df, key, least, name):
        tables.append((name, real(df, key, least, name)))
        kept = tables[-1][1].collect()
        tables[-1] = (*tables[-1], {r["name"] for r in kept})
        assert all((r["f"] is not None) == (r["at"] == r["name"]) == (r[key[0]] is not None) for r in kept)
        return tables[-1][1]

    monkeypatch.setattr(co, "_frequent", frequent)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert mined(df, shard_words=500, waves=3) == plain(rows)
    level = [names for name, _, names in tables if name == "fm-level2"]
    assert len(level) == 3 and all(level) and sum(map(len, level)) == len(set().union(*level))
