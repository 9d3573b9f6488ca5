"""The logarithmic family of suffix arrays, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.llm import suffix_dedup


def texts():
    """Copies of whole and half passages, edits, repeats within a text, short and empty texts, and nulls."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = [None, "", "short", passages[0], passages[0], passages[1] * 3, "é" * 300]
    for i in range(57):
        p = passages[i % 4].split()
        if i % 3 == 0:
            p[rnd.randrange(len(p))] = word()
        lo = rnd.randrange(20)
        out.append(" ".join([word() for _ in range(rnd.randint(0, 30))] + p[lo : lo + rnd.randint(15, 60)] + [word()]))
    return out


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept) of rows in order."""
    seen, out = set(), []
    for t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("batches", [8])
def test_batches_against_brute_force(spark, batches):
    rows = texts()
    out = suffix_dedup.dedup(frame(spark, list(enumerate(rows))), batches=batches).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out] == brute(rows)


def test_null_and_repeated_ids_in_several_batches(spark):
    rnd = random.Random(4)
    ids = [rnd.choice([None, 5, 5, 7, i]) for i in range(len(texts()))]
    got = suffix_dedup.dedup(frame(spark, list(zip(ids, texts(), strict=True))), batches=3).collect()
    # Which of several rows of one id comes first is by digest; whichever it is, each text keeps its first windows only.
    import hashlib

    order = sorted(zip(ids, texts(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, hashlib.sha256((r[1] or "").encode()).hexdigest() if r[1] is not None else ""))
    want = [(i, *b) for (i, _), b in zip(order, brute([t for _, t in order]), strict=True)]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == sorted(want, key=str)


def test_levels_merge_geometrically(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)  # deals the copies of hot entries over tasks
    rows = texts()
    docs = frame(spark, list(enumerate(rows))).select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_data"))
    family, sizes, n = suffix_dedup.SuffixFamily(), [], 0
    for k in range(7):
        batch = docs.where(F.col("_doc").between(k * 10, k * 10 + 9))
        copies, _ = family.add(batch)
        n += copies.count()
        sizes.append([size for size, _ in family.levels])
        held = [level.select("h", "seg").collect() for _, level in family.levels]
        assert len({tuple(r) for rows in held for r in rows}) == sum(len(rows) for rows in held)  # no entry twice
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]] and n > 0
    family.drop()
