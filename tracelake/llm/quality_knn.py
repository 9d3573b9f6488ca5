"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are trigrams of character shapes (letters by case, digits, white space, each punctuation mark), word
pairs that repeat, and words that occur before; they are hashed to ``DIMS`` counts. Weighted by term and inverse document
frequency and cut to ``RANK`` dimensions by a singular value decomposition of labelled documents, they are the latent
vectors. The labelled vectors go to every task (``MAX_TRAIN`` x ``RANK`` floats at most), which computes all cosines of its
documents against them, block by block, and weights the labels of the ``NEIGHBOURS`` nearest by similarity.

Bounds: at most ``MAX_TRAIN`` labelled documents are learnt from, the first by a hash of their ids. Every whole text is
scored. Defined cases: null and empty texts are the zero vector and score the share of good labels, as do all texts
where nothing is labelled (0.5); repeated rows score alike; other columns pass through, but for one called
``_score``, which gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, code_points, mix64
from .common import small_batches

DIMS, RANK, MAX_TRAIN, NEIGHBOURS = 2048, 48, 6_000, 15
BLOCK = 512


def _classes() -> np.ndarray:
    """A class below 64 for each code point below 0x3000, and one for the rest."""
    out = np.zeros(0x3001, np.int64)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 1 if c == "\n" else 2 if c.isspace() else 3 if c.islower() else 4 if c.isupper() else 5 if c.isdigit() else 6 if c.isalpha() else 7 + i % 56 if i < 128 else 63
    out[0x3000] = 6
    return out


def counts(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """Hashed term counts of texts, each row divided by the text's length."""
    points, at = code_points(texts)
    small = np.minimum(points, 0x3000)
    kind = classes[small]
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(at))
    tri = kind[:-2] * 4096 + kind[1:-1] * 64 + kind[2:]
    slot = (mix64(tri.astype(np.uint64) + np.uint64(77)) % np.uint64(DIMS - 32)).astype(np.int64) if len(tri) else tri
    inside = doc[:-2] == doc[2:]
    out = np.bincount(doc[:-2][inside] * DIMS + slot[inside], minlength=n * DIMS).astype(np.float32)
    space = (kind == 1) | (kind == 2)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        powers = mix64(np.arange(1, 65, dtype=np.uint64))
        where = np.arange(len(points)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(points)]))))
        value = np.where(space, np.uint64(0), (points.astype(np.uint64) + np.uint64(1)) * powers[where % 64])
        word = mix64(np.add.reduceat(value, starts))
        of = doc[starts]
        for k, back in enumerate((1, 2)):
            same = (word[back:] == word[:-back]) & (of[back:] == of[:-back])
            out += np.bincount(of[back:][same] * DIMS + DIMS - 32 + k, minlength=n * DIMS) * 4
        key = mix64(word + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        seen = np.ones(len(key), bool)
        seen[first] = False
        out += np.bincount(of[seen] * DIMS + DIMS - 30, minlength=n * DIMS)
    out = out.reshape(n, DIMS)
    return np.sqrt(out / np.maximum(np.diff(at)[:, None] - 1, 1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    project: np.ndarray  # DIMS x RANK, inverse document frequencies included
    vectors: np.ndarray  # labelled, of length 1
    labels: np.ndarray
    prior: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, label)."""
    small_batches(labelled.sparkSession)
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    sample = labelled.join(ids.distinct(), "doc_id", "left_semi").select("label", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = _classes()
        for b in batches:
            for first, texts in chunks(b["text"]):
                x = counts(texts, classes)
                yield pd.DataFrame({"label": b["label"].to_numpy()[first : first + len(texts)], "x": [r.tobytes() for r in x.astype(np.float16)]})

    rows = sample.mapInPandas(run, "label int, x binary").collect()
    if not rows:
        return Model(np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    y = np.array([float(r["label"]) for r in rows])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.25
    _, vectors = np.linalg.eigh(((x * idf).T @ (x * idf)).astype(np.float64))
    project = (idf[:, None] * vectors[:, ::-1][:, :RANK]).astype(np.float32)
    return Model(project, _unit(x @ project), y, float(y.mean()))


def vote(x: np.ndarray, model: Model) -> np.ndarray:
    """Scores of rows of counts, by exact cosines against every labelled vector."""
    out = np.full(len(x), model.prior)
    if not len(model.vectors):
        return out
    k = min(NEIGHBOURS, len(model.vectors))
    for i in range(0, len(x), BLOCK):
        latent = x[i : i + BLOCK] @ model.project
        cosines = _unit(latent) @ model.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosines, near, 1), 0, None).astype(float) ** 8 + 1e-9
        votes = (weight * model.labels[near]).sum(1) / weight.sum(1)
        out[i : i + BLOCK] = np.where(np.abs(latent).max(1) > 0, votes, model.prior)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with ``_score``."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("text", "_score")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = _classes()
        for b in batches:
            for first, texts in chunks(b["text"]):
                out = b.iloc[first : first + len(texts)][keep].copy()
                out["_score"] = vote(counts(texts, classes), model)
                yield out

    return docs.select(*keep, "text").mapInPandas(run, docs.select(*keep).schema.add("_score", "double"))
