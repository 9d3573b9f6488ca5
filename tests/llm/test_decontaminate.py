"""Decontamination against every window of every text, and its recall on edited passages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import decontaminate


def words(rnd, n, letters="abcdefghijklm"):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 8))) for _ in range(n)]


def found(docs, bench, **kw):
    return {r["doc_id"]: {m["item_id"] for m in r["_matches"]} for r in decontaminate.find(docs, bench, **kw).select("doc_id", "_matches").collect()}


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def brute(texts, items, idf):
    """Passages that have MIN_LCS of their words in order, and MIN_ANSWER of their telling ones, in some stretch of a text of twice their length; and the same with stretches as long as any window with its surroundings."""
    out = []
    for reach in (lambda n: 2 * n, lambda n: decontaminate.SCALES[-1] + 2 * n):
        sets = []
        for t in texts:
            w, hit = t.split(), set()
            for j, item in enumerate(items):
                p = item.split()
                hashes = decontaminate.bins_of([item], decontaminate.word_table())[0]
                telling = sorted(range(len(p)), key=lambda i: (-np.float32(idf(p[i])), hashes[i]))[: max(decontaminate.TELLING, len(p) // decontaminate.TELLING)]
                telling = {p[i] for i in telling}
                for s in range(len(w)):
                    near = w[s : s + reach(len(p))]
                    if len(telling.intersection(near)) >= decontaminate.MIN_ANSWER * len(telling) and lcs_table(p, near) >= decontaminate.MIN_LCS * len(p):
                        hit.add(j)
                        break
            sets.append(hit)
        out.append(sets)
    return out


def test_against_every_window(spark):
    rnd = random.Random(31)
    items = [" ".join(words(rnd, rnd.randint(6, 20))) for _ in range(8)]
    texts = []
    for i in range(60):
        copy = items[i % 8].split()
        for k in rnd.sample(range(len(copy)), int(len(copy) * rnd.choice([0, 0.2, 0.4, 0.5, 0.7]))):
            copy[k] = words(rnd, 1)[0]
        if i % 4 == 0:  # stretched
            copy = [x for c in copy for x in (c, *words(rnd, rnd.randint(0, 1)))]
        texts.append(" ".join(words(rnd, rnd.randint(0, 40)) + copy + words(rnd, rnd.randint(0, 40))))
    freq = {}
    for t in texts:
        for x in set(t.split()):
            freq[x] = freq.get(x, 0) + 1
    least, most = brute(texts, items, lambda x: max(math.log((1 + len(texts)) / (1 + max(freq.get(x, 0), 1))), decontaminate.FLOOR))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = found(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    for i in range(len(texts)):
        assert least[i] <= got[i] <= most[i], i
    assert sum(map(len, least)) > 30


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.1, 0.99), (0.2, 0.97), (0.3, 0.92), ("swap", 0.9)])
def test_recall_on_edited_passages(spark, share, least):
    """Words replaced at random in whole documents of one corpus; swap: the two halves of a passage in reverse order."""
    rnd = random.Random(32)
    common = words(rnd, 40)
    text = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else words(rnd, 1)[0] for _ in range(n)]
    items = [text(rnd.randint(15, 59)) for _ in range(200)]
    docs = []
    for i, item in enumerate(items):
        copy = list(item)
        if share == "swap":
            half = len(copy) // 2
            copy = copy[half:] + copy[:half]
        else:
            for k in rnd.sample(range(len(copy)), round(len(copy) * share)):
                copy[k] = words(rnd, 1)[0]
        docs.append((i, " ".join(text(60) + copy + text(60))))
    clean = [(1000 + i, " ".join(text(180))) for i in range(200)]
    got = found(spark.createDataFrame(docs + clean, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string"))
    recall = sum(i in got[i] for i in range(200)) / 200
    print("recall", share, recall, "of others", sum(len(got[i] - {i}) for i in range(200)), "clean", sum(bool(got[i]) for i, _ in clean))
    assert recall >= least and not any(got[i] for i, _ in clean)


def test_other_columns_and_odd_tables(spark):
    rnd = random.Random(33)
    item = " ".join(words(rnd, 20))
    docs = spark.createDataFrame([(None, item, 1), (3, "", 2), (3, None, 3), (3, item, 4)], "id bigint, body string, _matches int")
    bench = spark.createDataFrame([(7, item)], "n bigint, passage string")
    out = decontaminate.find(docs, bench, text="body", item_id="n", item_text="passage")
    assert sorted((str(r["id"]), len(r["_matches"])) for r in out.collect()) == [("3", 0), ("3", 0), ("3", 1), ("None", 1)]
    empty = docs.limit(0)
    assert decontaminate.find(empty, bench, text="body", item_id="n", item_text="passage").count() == 0
    assert decontaminate.find(docs, bench.where(F.lit(False)), text="body", item_id="n", item_text="passage").where("size(_matches) > 0").count() == 0


def test_model_is_of_all_documents(spark, monkeypatch):
    """The latent vectors are the axes of all documents and passages, of more documents than were once sampled."""
    rnd = random.Random(34)
    vocabulary = sorted({*words(rnd, 24)})
    items = [" ".join(rnd.sample(vocabulary, 8)) for _ in range(5)]
    known = sorted({x for i in items for x in i.split()})
    texts = [" ".join(rnd.choices(vocabulary, weights=[1 + k % 5 for k in range(len(vocabulary))], k=rnd.randint(1, 12))) for _ in range(2500)] + [None, "", "unknown"]
    real, got = decontaminate.decompose, []
    monkeypatch.setattr(decontaminate, "decompose", lambda *a: got.append(real(*a)) or got[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    hashes = decontaminate.bins_of([" ".join(known)], decontaminate.word_table())[1]
    known = [known[i] for i in np.argsort(hashes)]
    idf = [max(math.log((1 + len(texts)) / (1 + max(sum(x in (t or "").split() for t in texts), 1))), decontaminate.FLOOR) for x in known]
    rows = np.array([[(t or "").split().count(x) * w for x, w in zip(known, idf)] for t in texts + items])
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    rows[: len(texts)] *= math.sqrt(20 / len(texts))
    gram = got[0].T @ (rows.T @ rows) @ got[0]
    assert gram.shape == (len(known), len(known))
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-4 * gram.max()
