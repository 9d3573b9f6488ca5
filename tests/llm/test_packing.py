"""Packing: dominance against exhaustive search, sequences against their lengths, ids against the tokenizer itself."""

import random
import zlib
from collections import Counter
from functools import cache
from math import ceil

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelake.llm import packing
from tracelake.llm.queries import op13_best_fit_packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


def fewest(pieces, capacity):
    """The least number of sequences, by trying all sets for the longest piece."""

    @cache
    def least(left):
        if not left:
            return 0
        first, rest, best = left[0], left[1:], len(left)

        def fill(i, room, out):
            nonlocal best
            best = min(best, 1 + least(tuple(out) + rest[i:]))
            for k in range(i, len(rest)):
                if rest[k] <= room and (k == i or rest[k] != rest[k - 1]):
                    fill(k + 1, room - rest[k], [*out, *rest[i:k]])

        fill(0, capacity - first, [])
        return best

    return least(tuple(sorted(pieces, reverse=True)))


def pieces_of(sequences):
    return Counter(w for s, n in sequences for w in s * n)


@pytest.mark.parametrize("seed", range(150))
def test_fixed_sets_cost_nothing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 12, 20, 30])
    pieces = [rng.randint(rng.choice([1, capacity // 4, capacity // 3]), capacity) for _ in range(rng.randint(1, 10))]
    fixed, left = packing.reduce_counts(Counter(pieces), capacity)
    assert pieces_of(fixed) + Counter(left) == Counter(pieces)
    assert sum(n for _, n in fixed) + fewest(Counter(left).elements(), capacity) == fewest(pieces, capacity)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_whole_and_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6.3, 1.0 + seed % 3 * 0.4, 20_000).astype(int) + 1, 1, 2048).tolist()
    sequences = packing.plan(Counter(lengths))
    assert pieces_of(sequences) == Counter(lengths) and all(sum(s) <= 2048 for s, _ in sequences)
    assert sum(n for _, n in sequences) <= ceil(sum(lengths) / 2048) * 1.003 + 1 or sum(n for _, n in sequences) == sum(x > 1024 for x in lengths)


def test_best_fit_alone_as_item_by_item():
    rng = random.Random(5)
    for _ in range(50):
        pieces = sorted((rng.randint(1, 40) for _ in range(60)), reverse=True)
        rooms = []
        for w in pieces:
            room = min((r for r in rooms if r >= w), default=None)
            if room is not None:
                rooms.remove(room)
            rooms.append((40 if room is None else room) - w)
        assert sum(n for _, n in packing.best_fit(Counter(pieces), 40)) == len(rooms)


def test_steps_follow_lengths_and_not_pieces():
    """A thousand times the pieces make no more runs."""
    rng = np.random.default_rng(1)
    one = Counter(np.clip(rng.lognormal(6.3, 1.1, 50_000).astype(int) + 1, 1, 2048).tolist())
    runs = [len(packing._runs(packing.plan({w: n * k for w, n in one.items()}))["length"]) for k in (1, 1000)]
    assert runs[1] < 2 * runs[0] + 5000


def check(rows, texts, capacity, end_id=0):
    """rows of one packing against plain encoding."""
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, end_id] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            part = np.array(ids[i][at : at + r["length"]], "<u4").tobytes()
            assert (r["ids_crc32"] if "ids_crc32" in r else zlib.crc32(r["ids"])) == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(map(len, ids.values()))


def test_query_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n, total = check([r.asDict() for r in op13_best_fit_packing(spark, sf).collect()], texts, 2048)
    assert n <= ceil(total / 2048) + 1


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: " " * 40_000, 4: "\n" * 3000 + "x" + "\t" * 3000, 5: "<|endoftext|> is text", 6: "é ñ 한국어 中文 \U0001f600 don't 123 ​", 7: "word " * 9000, 8: "a" * 20_000, 9: "x", 10: "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = [r.asDict() for r in packing.pack(docs.selectExpr("*", "'mine' AS _text", "'mine' AS _at", "'mine' AS _part", "'mine' AS piece"), JSON, capacity=64).collect()]
    assert all(r["_text"] == r["_at"] == r["_part"] == "mine" for r in out)
    check(out, texts, 64)
    assert packing.pack(docs.where("false"), JSON).count() == 0
    twice = packing.pack(docs.union(docs), JSON).groupBy("doc_id").count().collect()
    assert all(r["count"] % 2 == 0 for r in twice)


def test_long_pieces_are_refused():
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_other_tokenizers_go_plainly():
    assert packing.Encoder(JSON).quick is not None and packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).quick is None
