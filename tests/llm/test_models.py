"""Held-out figures of the two classifiers on the given tables, and neighbours against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import quality_knn, queries, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    out = queries.queries()[name](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y")).where("y IS NOT NULL"), "doc_id").toPandas()
    y, score = out["y"].to_numpy(), out["score"].to_numpy()
    rank = out["score"].rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    right = out["predicted"].to_numpy() == y
    print(name, len(y), "accuracy", right.mean(), "auc", auc, "recall", right[y == 1].mean(), "clean left alone", right[y == 0].mean())
    assert ((score >= 0) & (score <= 1)).all()
    return right.mean(), auc, right[y == 1].mean(), right[y == 0].mean()


def test_toxicity(spark):
    accuracy, auc, recall, clean = held_out(spark, "op4_toxicity", "toxic")
    assert accuracy >= 0.98 and auc >= 0.96 and recall >= 0.9 and clean >= 0.99


def test_terms_of_any_script_and_number(spark):
    """More than a thousand planted terms, and terms in Korean and Japanese letters, with and without an edit."""
    letters = "bcdfghjklmnpqrstvwxz"
    word = lambda i: "".join(letters[i // 20**k % 20] + "aeiou"[(i + k) % 5] for k in range(4))
    bad = [word(i * 67 + 3) for i in range(1200)]
    rows = []
    for i in range(2400):
        mine = [bad[(i // 2 * 20 + k) % len(bad)] for k in range(20)] + ["바보멍청이들", "ばかやろうども"]
        rows.append((i, " ".join(mine if i % 2 else ["a", "calm", "day", "and", "nothing", "else", "오늘은", "きょうは"]), i % 2))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    terms = {t for t, _, _ in model.lexicon.entries}
    assert sum(any(b[:k] in terms for k in range(4, len(b) + 1)) for b in bad) == len(bad)
    texts = [bad[0], "바보멍청이들", "바보멍청이둘", "ばかやろうども", "calm day", "오늘은"]
    got = [r["_score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).collect()]
    assert min(got[:4]) > 2 * max(got[4:])


def test_quality(spark):
    accuracy, auc, _, _ = held_out(spark, "op5_quality_knn", "quality")
    assert accuracy >= 0.99 and auc >= 0.99


@pytest.mark.parametrize("k", [3, 15])
def test_votes_against_all_cosines(monkeypatch, k):
    monkeypatch.setattr(quality_knn, "NEIGHBOURS", k)
    rng = np.random.default_rng(7)
    project = rng.standard_normal((quality_knn.DIMS, 8)).astype(np.float32)
    vectors = quality_knn._unit(rng.standard_normal((400, 8)).astype(np.float32))
    labels = (rng.random(400) < 0.6).astype(float)
    x = np.abs(rng.standard_normal((1100, quality_knn.DIMS))).astype(np.float32)
    x[5] = 0
    got = quality_knn.vote(x, quality_knn.Model(project, vectors, labels, 0.25))
    for i in range(0, 1100, 37):
        latent = (x[i] @ project).astype(float)
        cosines = np.array([latent @ v / np.linalg.norm(latent) for v in vectors.astype(float)])
        near = np.argsort(-cosines)[:k]
        weight = np.clip(cosines[near], 0, None) ** 8 + 1e-9
        assert abs(got[i] - (weight * labels[near]).sum() / weight.sum()) < 1e-3
    assert got[5] == 0.25
