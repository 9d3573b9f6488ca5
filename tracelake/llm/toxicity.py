"""Toxicity: terms of a lexicon, found even if misspelled, in context windows.

The lexicon (whole words, and stems that begin words) is learnt from labelled documents and joined with a short fixed
list. It is laid out as a trie, and Levenshtein automata of its terms are intersected with it once, on the driver: the
states are sets of (trie node, edits so far), made deterministic. Words and stems of ``EDIT_LETTERS`` letters and more may have one
letter wrong, missing or too many, unless the labelled documents show that such words are everyday words. Every word of every text then runs through that one
table, all words of a chunk at a time. Hits count apart if they are quoted (quotation marks or reporting verbs around),
and their density in windows of words is taken; a logistic model over these few numbers gives the score.

Bounds: learning reads at most ``MAX_TRAIN`` labelled documents, the first by
a hash of their ids, and whole texts of these. A term is learnt if the sample has evidence enough for it (a likelihood
ratio of ``MIN_EVIDENCE``, beyond what the best of a million chance terms reaches), and it neither begins a better one nor
begins with one; so the terms' number follows from the sample alone. Letters of all scripts make words.
Scoring reads every whole text. Defined cases: null and empty texts get the score of a text without
hits; repeated rows score alike; without labels of both kinds the fixed list alone decides; other columns pass through, but for
one called ``_score``, which gives way.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .arrays import chunks, code_points
from .common import drop_tables, small_batches, stage_table

MAX_TRAIN, MIN_LOG_ODDS, MIN_EVIDENCE, EDIT_LETTERS = 12_000, 1.7, 25.0, 5
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "imbecile", "dumbass", "retard", "bastard", "bitch", "asshole", "idiota", "estúpido", "imbécil", "connard", "salope", "crétin", "arschloch", "trottel", "hurensohn", "dummkopf", "abschaum")
REPORTING = {"said", "says", "wrote", "called", "quote", "quoted", "quotes", "cited", "reported", "sagte", "schrieb", "zitat", "dit", "écrit", "cite", "dijo", "escribió", "cita"}
QUOTES = '"“”„«»‹›'
WINDOW_WORDS, QUOTE_CHARS = 40, 60
FEATURES = ("words", "stems", "quoted", "window", "per_100", "most_of_one", "kinds", "length")


@dataclass(frozen=True)
class Lexicon:
    """entries: (term, is it a stem, edits). table[state, class] is the next state; state 0 rejects."""

    entries: tuple[tuple[str, bool, int], ...]
    classes: dict[str, int]
    table: np.ndarray
    accepts: np.ndarray  # entry of a state at a word's end, or -1
    fuzzy: np.ndarray
    stops: np.ndarray  # entry of a stem that is complete in a state without edits, or -1
    nearly: np.ndarray  # the same with edits


def with_edits(terms: list[tuple[str, bool]], exact: frozenset[str] = frozenset()) -> list[tuple[str, bool, int]]:
    """Entries of terms (term, is it a stem): one edit, but none in short terms and those in exact."""
    return [(t, stem, 0 if t in exact or len(t) < EDIT_LETTERS else 1) for t, stem in terms]


def compile_lexicon(entries: list[tuple[str, bool, int]]) -> Lexicon:
    """The intersection of the terms' Levenshtein automata with their trie, made deterministic."""
    kids: list[dict[str, int]] = [{}]
    ends: list[list[int]] = [[]]
    reach: list[int] = [0]  # most edits that any word below a node allows
    for n, (term, _, edits) in enumerate(entries):
        node = 0
        for c in term:
            reach[node] = max(reach[node], edits)
            if c not in kids[node]:
                kids[node][c] = len(kids)
                kids.append({})
                ends.append([])
                reach.append(0)
            node = kids[node][c]
        reach[node] = max(reach[node], edits)
        ends[node].append(n)
    letters = sorted({c for t, _, _ in entries for c in t})
    classes = {c: i + 1 for i, c in enumerate(letters)}

    def closed(items: set[tuple[int, int]]) -> frozenset:
        todo = list(items)
        best: dict[int, int] = {}
        while todo:
            node, e = todo.pop()
            if e > reach[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(k, e + 1) for k in kids[node].values()]  # a letter of the term is missing in the word
        return frozenset(best.items())

    start = closed({(0, 0)})
    states, rows, todo = {frozenset(): 0, start: 1}, {0: [0] * (len(letters) + 1)}, deque([start])
    accepts, fuzzy, stops, nearly = [-1, -1], [False, False], [-1, -1], [-1, -1]

    def note(items: frozenset, at: int) -> None:
        for node, e in sorted(items, key=lambda x: (x[1], x[0])):
            for n in ends[node]:
                if e <= entries[n][2] and accepts[at] < 0:
                    accepts[at], fuzzy[at] = n, e > 0
                if entries[n][1] and e == 0:
                    stops[at] = n
                elif entries[n][1] and e <= entries[n][2] and nearly[at] < 0:
                    nearly[at] = n

    while todo:
        items = todo.popleft()
        row = []
        for c in [None, *letters]:
            out = set()
            for node, e in items:
                if c in kids[node]:
                    out.add((kids[node][c], e))
                if e < reach[node]:
                    out.add((node, e + 1))  # a letter too many
                    out |= {(k, e + 1) for x, k in kids[node].items() if x != c}  # another letter
            new = closed(out)
            if new not in states:
                states[new] = len(states)
                accepts.append(-1)
                fuzzy.append(False)
                stops.append(-1)
                nearly.append(-1)
                note(new, states[new])
                todo.append(new)
            row.append(states[new])
        rows[states[items]] = row
    return Lexicon(tuple(entries), classes, np.array([rows[i] for i in range(len(states))], np.int32), np.array(accepts), np.array(fuzzy), np.array(stops), np.array(nearly))


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter, of any script."""
    return np.array([chr(i).isalpha() or i in (0x300, 0x301) for i in range(0x110000)])


class Reader:
    """Runs texts through a lexicon; one for each task."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.letter = letters()
        self.kind = np.zeros(len(self.letter), np.int32)
        self.quote = np.zeros(len(self.letter), bool)
        self.kind[[ord(c) for c in lexicon.classes]] = list(lexicon.classes.values())
        self.quote[[ord(c) for c in QUOTES]] = True

    def features(self, texts: list[str]) -> np.ndarray:
        return self.read(texts)[0]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The features of texts; and entry and text of every hit with an edit (2 x hits)."""
        lex = self.lexicon
        points, at = code_points([t.lower() for t in texts])
        letter = self.letter[points]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        out = np.zeros((len(texts), len(FEATURES)))
        of_word = np.searchsorted(at, starts, "right") - 1
        n_words = np.bincount(of_word, minlength=len(texts))
        out[:, 7] = np.log1p(n_words)
        none = np.zeros((2, 0), np.int64)
        if not len(starts):
            return out, none
        entry, is_fuzzy = np.full(len(starts), -1), np.zeros(len(starts), bool)
        alive, state, step = np.arange(len(starts)), np.ones(len(starts), np.int32), 0
        kind = self.kind[points]
        while len(alive):
            over = ends[alive] <= starts[alive] + step
            if over.any():
                done, s = alive[over], state[over]
                whole = lex.accepts[s] >= 0
                entry[done[whole]], is_fuzzy[done[whole]] = lex.accepts[s[whole]], lex.fuzzy[s[whole]]
                alive, state = alive[~over], state[~over]
            state = lex.table[state, kind[starts[alive] + step]]
            stop = lex.stops[state]
            hit = stop >= 0
            entry[alive[hit]], is_fuzzy[alive[hit]] = stop[hit], False
            # A stem with an edit counts unless the rest of the word makes a better match.
            near = lex.nearly[state]
            m = (near >= 0) & ~hit & (entry[alive] < 0)
            entry[alive[m]], is_fuzzy[alive[m]] = near[m], True
            go = (state > 0) & ~hit
            alive, state, step = alive[go], state[go], step + 1
        hits = np.flatnonzero(entry >= 0)
        if not len(hits):
            return out, none
        docs, what = of_word[hits], entry[hits]
        quotes = np.concatenate(([0], np.cumsum(self.quote[points])))
        lo, hi = np.maximum(starts[hits] - QUOTE_CHARS, at[docs]), np.minimum(ends[hits] + QUOTE_CHARS, at[docs + 1])
        quoted = (quotes[starts[hits]] > quotes[lo]) & (quotes[hi] > quotes[ends[hits]])
        reported = np.array([any(points[starts[w] : ends[w]].tobytes().decode("utf-32-le") in REPORTING for w in range(max(0, h - 3), h)) for h in hits])
        stem = np.array([s for _, s, _ in lex.entries])[what]
        plain = ~quoted & ~reported
        count = lambda m: np.bincount(docs[m], minlength=len(texts)).astype(float)
        out[:, 0], out[:, 1], out[:, 2] = (np.log1p(count(m)) for m in (plain & ~stem, plain & stem, ~plain))
        near = np.arange(len(hits)) - np.searchsorted(docs.astype(np.int64) * (1 << 40) + hits, docs.astype(np.int64) * (1 << 40) + hits - WINDOW_WORDS) + 1
        np.maximum.at(out[:, 3], docs, np.log1p(near))
        out[:, 4] = np.log1p(100 * count(np.ones(len(hits), bool)) / np.maximum(n_words, 1))
        each, n = np.unique(docs.astype(np.int64) * len(lex.entries) + what, return_counts=True)
        np.maximum.at(out[:, 5], each // len(lex.entries), np.log1p(n))
        out[:, 6] = np.log1p(np.bincount(each // len(lex.entries), minlength=len(texts)))
        return out, np.stack((what, docs))[:, is_fuzzy[hits]]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant


def learn_entries(sample: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems that documents with the label have far more often than others."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    one = sample.select("doc_id", "label", F.explode(words).alias("w")).groupBy("doc_id", "label", "w").agg(F.count("*").alias("n"))
    cuts = F.concat(F.array(F.struct(F.col("w").alias("t"), F.lit(False).alias("stem"))), F.transform(F.sequence(F.lit(4), F.least(F.lit(8), F.length("w"))), lambda k: F.struct(F.substring(F.col("w"), F.lit(1), k).alias("t"), F.lit(True).alias("stem"))))
    some = one.where(F.length("w") >= 4).select("doc_id", "label", "n", F.explode(cuts).alias("c")).groupBy("doc_id", "label", "c.t", "c.stem").agg(F.sum("n").alias("n"))
    at_least = lambda lab, k: F.sum(((F.col("label") == lab) & (F.col("n") >= k)).cast("long"))
    rows = some.groupBy("t", "stem").agg(*[at_least(lab, k).alias(f"{x}{k}") for lab, x in ((1, "a"), (0, "b")) for k in (1, 2)])
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return []
    odds = lambda k: F.log((F.col(f"a{k}") + 0.5) * n0 / ((F.col(f"b{k}") + 2.0) * n1))
    # Evidence: twice the log-likelihood that a term's share differs between the labels, over that it doesn't.
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)

    def evidence(k: int) -> Column:
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        apart = part(a, F.lit(n1)) + part(n1 - a, F.lit(n1)) + part(b, F.lit(n0)) + part(n0 - b, F.lit(n0))
        return 2 * (apart - part(a + b, F.lit(n1 + n0)) - part(n1 + n0 - a - b, F.lit(n1 + n0)))

    # Whole words before stems, and longer stems before shorter ones, unless these tell more.
    score = lambda k: F.when((odds(k) > MIN_LOG_ODDS) & (evidence(k) >= MIN_EVIDENCE), evidence(k) * F.when(F.col("stem"), 1 + 0.02 * F.length("t")).otherwise(1.25)).otherwise(0.0)
    best = rows.where("a1 >= 3").withColumn("score", F.greatest(score(1), score(2))).where("score > 0").orderBy(F.desc("score"), "t", "stem")
    chosen: list[tuple[str, bool]] = []
    names: set[str] = set()
    heads: set[str] = set()  # beginnings of the chosen terms
    for r in best.collect():
        t = r["t"]
        if len(t) >= 4 and t not in heads and not any(t[:k] in names for k in range(1, len(t) + 1)):
            chosen.append((t, r["stem"]))
            names.add(t)
            heads.update(t[:k] for k in range(1, len(t) + 1))
    return chosen


def useless_edits(sample: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Terms whose hits with an edit don't tell the labels apart, as everyday words are that near to them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon)
        for b in batches:
            for first, texts in chunks(b["text"]):
                entry, doc = np.unique(reader.read(texts)[1], axis=1)
                yield pd.DataFrame({"entry": entry, "label": b["label"].to_numpy()[first + doc]})

    seen = sample.select("label", "text").mapInPandas(run, "entry int, label int").groupBy("entry").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).collect()
    total = sample.agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).first()
    # Without any hit in clean documents an edit stays, however few the others are.
    odds = lambda r: np.log((r["a"] + 0.5) * total["b"] / ((r["b"] + 0.5) * max(total["a"], 1)))
    return frozenset(lexicon.entries[r["entry"]][0] for r in seen if r["b"] and odds(r) < MIN_LOG_ODDS)


def fit(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, label)."""
    small_batches(labelled.sparkSession)
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    sample = stage_table(labelled.join(ids.distinct(), "doc_id", "left_semi").select("doc_id", "text", F.col("label").cast("int").alias("label")), "toxicity-sample")
    learnt = learn_entries(sample)
    known = {t for t, _ in learnt}
    terms = learnt + [(t, False) for t in SEED_TERMS if t not in known]
    lexicon = compile_lexicon(with_edits(terms, useless_edits(sample, compile_lexicon(with_edits(terms)))))
    rows = with_features(sample.select("label", "text"), lexicon).select("label", "_features").collect()
    drop_tables(sample)
    if len({r["label"] for r in rows}) < 2:
        weights = np.zeros(len(FEATURES) + 1)
        weights[[0, -1]] = 3.0, -3.0
        return Model(lexicon, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), weights)
    x, y = np.array([r["_features"] for r in rows]), np.array([float(r["label"]) for r in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    weights = np.zeros(z.shape[1])
    for _ in range(40):  # Newton steps of a logistic model with a small penalty
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        grad = z.T @ (p - y) + 0.5 * np.append(weights[:-1], 0)
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([0.5] * len(FEATURES) + [1e-6])
        step = np.linalg.solve(hess, grad)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(lexicon, mean, scale, weights)


def with_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    return _mapped(docs, lexicon, None)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with ``_score``."""
    return _mapped(docs, model.lexicon, model)


def _mapped(docs: DataFrame, lexicon: Lexicon, model: Model | None) -> DataFrame:
    small_batches(docs.sparkSession)
    result = "_features" if model is None else "_score"
    keep = [c for c in docs.columns if c not in ("text", result)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon)
        for b in batches:
            for first, texts in chunks(b["text"]):
                x = reader.features(texts)
                out = b.iloc[first : first + len(texts)][keep].copy()
                if model is None:
                    out["_features"] = list(x)
                else:
                    z = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
                    out["_score"] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield out

    schema = docs.select(*keep).schema
    schema = schema.add("_features", ArrayType(DoubleType())) if model is None else schema.add("_score", "double")
    return docs.select(*keep, "text").mapInPandas(run, schema)
