"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages, with all documents, are weighted by term and inverse document frequency, and a distributed
randomised singular value decomposition gives their latent space: documents are read once into bags of the benchmark's
terms, which are staged, and every task sends only its share of the products of its bags with a random and then an
orthonormal basis, in blocks of terms that tasks add up. So that the passages keep their part in the space, however many
documents there are, these weigh ``DOC_MASS`` passages together at most. Each document is read whole in overlapping windows of several lengths; windows whose cosine with a
benchmark passage is high enough are candidates, which are checked word by word: by the longest common subsequence, and
by how many of the passage's telling words (its answer: those of the highest weight) are near. As a match needs so many
telling words, only windows that can have them are compared; that leaves out no match. The latent space has a fixed rank
and can miss passages of a large benchmark, so the places of telling words are candidates too, of whatever cosine, for
the same checks: a copy stretched to twice its length at most is found.

Bounds: the benchmark is the stated query set, up to ``MAX_ITEMS`` passages, sent to every task with its latent vectors
(at most ``BINS`` terms times ``RANK`` numbers, which the driver holds too). All documents are counted, fitted and searched. Defined cases: null or empty texts and
passages match nothing; passages of fewer than ``MIN_WORDS`` words are left out; repeated rows each get their matches; an
empty benchmark matches nothing; other columns pass through, but for one called ``_matches``, which gives way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .arrays import chunks, code_points, word_hashes, word_table
from .common import drop_tables, small_batches, stage_table

BINS, RANK, OVERSAMPLE, MAX_ITEMS, MIN_WORDS = 1 << 18, 256, 16, 200_000, 5
#: A document weighs DOC_WEIGHT passages, and all documents DOC_MASS at most. So many cells of documents by terms are multiplied at once.
DOC_WEIGHT, DOC_MASS, CELLS = 0.01, 20, 4_000_000
#: Lengths of windows in words; each doubles the one before, the first is two units.
SCALES, UNIT, TILE = (12, 24, 48), 6, 512
#: Least weight of a term: those of everyday words, and of passages that are in many documents, count too.
FLOOR = 0.05
#: The telling words of a passage are a quarter of it, four at least. With a third of a passage's words replaced at random, more
#: than nine in ten still have these shares (README).
MIN_COSINE, MIN_LCS, MIN_ANSWER, TELLING, TERMS = 0.2, 0.5, 0.4, 4, 4_096
MATCHES = ArrayType(StructType().add("item_id", LongType()).add("cosine", DoubleType()).add("lcs", DoubleType()).add("answer", DoubleType()))


def bins_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their bins and their texts."""
    points, at = code_points([t.lower() for t in texts])
    words, of = word_hashes(points, at, table)
    return words, (words & np.uint64(BINS - 1)).astype(np.int64), of


def bags(texts: DataFrame, row_of: np.ndarray) -> DataFrame:
    """bin, n: in how many texts each bin occurs, by tasks (bin -1: how many texts there are). At bin -2, for a chunk of texts: how many of the benchmark's terms each has, these terms, and how often each is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total, n = word_table(), np.zeros(BINS, np.int64), 0
        for b in batches:
            for _, texts in chunks(b["text"]):
                _, bins, of = bins_of(texts, table)
                n += len(texts)
                pairs, count = np.unique(of * BINS + bins, return_counts=True)
                text, bins = pairs // BINS, pairs & (BINS - 1)
                total += np.bincount(bins, minlength=BINS)
                known = row_of[bins] >= 0
                arrays = np.bincount(text[known], minlength=len(texts)), row_of[bins[known]], count[known]
                yield pd.DataFrame({"bin": [-2], "n": [len(texts)], **{k: [x.astype(np.uint32).tobytes()] for k, x in zip(("sizes", "terms", "counts"), arrays, strict=True)}})
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bin": np.append(seen, -1), "n": np.append(total[seen], n), "sizes": None, "terms": None, "counts": None})

    return texts.mapInPandas(run, "bin long, n long, sizes binary, terms binary, counts binary")


def document_frequencies(counted: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bin occurs, and the number of documents, of bags."""
    counted = counted.where("bin >= -1").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BINS + 1, np.int64)
    out[counted["bin"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out[:BINS], int(out[BINS])


def _rows(bins: np.ndarray, of: np.ndarray, row_of: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of texts over the benchmark's terms, each of length 1: text, term and value, in this order."""
    m = row_of[bins] >= 0
    key, first, count = np.unique(of[m].astype(np.int64) * size + row_of[bins[m]], return_index=True, return_counts=True)
    text, value = key // size, count * weight[bins[m][first]].astype(float)
    norm = np.sqrt(np.bincount(text, weights=value**2, minlength=1))
    return text, key % size, value / np.maximum(norm[text], 1e-9)


def _sums(to: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """rows added up by to, which is in order."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(to):
        begin = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        out[to[begin]] = np.add.reduceat(rows, begin, axis=0)
    return out


def dense_rows(sizes: bytes, terms: bytes, counts: bytes, scale: float, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms, and TF-IDF rows of length scale over them, of the texts of a bag that have terms; some texts at a time."""
    size, term, count = (np.frombuffer(x, np.uint32).astype(np.int64) for x in (sizes, terms, counts))
    size = size[size > 0]
    text = np.repeat(np.arange(len(size)), size)
    value = count * weight[term].astype(float)
    value *= scale / np.sqrt(np.bincount(text, weights=value**2, minlength=1))[text]
    used, at = np.unique(term, return_inverse=True)
    step = max(1, CELLS // max(len(used), 1))
    ends = np.concatenate(([0], np.cumsum(size)))
    for lo in range(0, len(size), step):
        hi = min(lo + step, len(size))
        part = slice(ends[lo], ends[hi])
        out = np.zeros((hi - lo, len(used)), np.float32)
        out[text[part] - lo, at[part]] = value[part]
        yield used, out


def decompose(rows: DataFrame, weight: np.ndarray) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the TF-IDF rows of bags (scale, sizes, terms, counts)."""
    size = len(weight)
    rank = min(RANK + OVERSAMPLE, size)
    # As many tasks as run at once: each sends a sum as large as the basis.
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)

    def products(basis: np.ndarray, both: bool) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((basis.shape[1] if both else size, basis.shape[1]), np.float32)
            for b in batches:
                for bag in zip(b["sizes"], b["terms"], b["counts"], b["scale"], strict=True):
                    for used, x in dense_rows(*bag, weight):
                        y = x @ basis[used]
                        if both:
                            total += y.T @ y
                        else:
                            total[used] += x.T @ y
            for k in range(0, len(total), TERMS):
                yield pd.DataFrame({"block": [k // TERMS], "part": [total[k : k + TERMS].tobytes()]})

        def added(block: pd.DataFrame) -> pd.DataFrame:
            whole = sum(np.frombuffer(x, np.float32) for x in block["part"])
            return pd.DataFrame({"block": block["block"][:1], "part": [whole.tobytes()]})

        parts = rows.mapInPandas(run, "block int, part binary").groupBy("block").applyInPandas(added, "block int, part binary").orderBy("block").collect()
        return np.concatenate([np.frombuffer(r["part"], np.float32) for r in parts]).reshape(-1, basis.shape[1])

    basis, _ = np.linalg.qr(products(np.random.default_rng(5).standard_normal((size, rank)).astype(np.float32), both=False))
    values, vectors = np.linalg.eigh(products(basis, both=True).astype(float))
    return (basis @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def find(docs: DataFrame, benchmark: DataFrame, corpus: DataFrame | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs (any columns, with a text) with ``_matches``: item_id, cosine, lcs and answer of each match.

    corpus (with the same text column) is what term frequencies are counted over and the latent space is fitted to; docs themselves by default.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("_matches")
    text_col, passages = text, benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = passages.orderBy("item_id", "text").limit(MAX_ITEMS + 1).toPandas()
    if len(items) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} passages: search the benchmark in parts")
    schema = StructType([*docs.schema.fields]).add("_matches", MATCHES)
    words, bins, of = bins_of(list(items["text"]), word_table()) if len(items) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n_words = np.bincount(of, minlength=len(items))
    if not (n_words >= MIN_WORDS).any():
        return docs.withColumn("_matches", F.array().cast(MATCHES))
    terms = np.unique(bins)
    row_of = np.full(BINS, -1, np.int32)
    row_of[terms] = np.arange(len(terms))
    counted = stage_table(bags((docs if corpus is None else corpus).select(F.col(text_col).alias("text")), row_of), "latent-bags")
    freq, n_docs = document_frequencies(counted)
    # A word that no document has tells no more than one of a single document: the passage may be here with that word replaced.
    idf = np.log((1 + n_docs) / (1 + np.maximum(freq, 1)))
    weight = np.maximum(idf, FLOOR).astype(np.float32)
    scale = np.sqrt(min(DOC_WEIGHT, DOC_MASS / max(n_docs, 1)))
    rows = counted.withColumn("scale", F.lit(float(scale))).union(bags(passages.select("text"), row_of).withColumn("scale", F.lit(1.0))).where("bin = -2").drop("bin", "n")
    vectors = decompose(rows, weight[terms])
    drop_tables(counted)
    cut = np.searchsorted(of, np.arange(0, len(items) + TILE, TILE))
    latent = np.zeros((len(items), vectors.shape[1]), np.float32)
    for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        text, term, value = _rows(bins[lo:hi], of[lo:hi] - i * TILE, row_of, weight, len(terms))
        latent[i * TILE : (i + 1) * TILE] = _sums(text, vectors[term] * value[:, None], min(TILE, len(items) - i * TILE))
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = np.where((norm > 1e-6) & (n_words >= MIN_WORDS)[:, None], latent / np.maximum(norm, 1e-6), 0).astype(np.float32)
    of_words = np.split(words, np.cumsum(n_words)[:-1])
    of_bins = np.split(bins, np.cumsum(n_words)[:-1])
    ids = items["item_id"].to_numpy()
    answers = [frozenset(w[np.lexsort((w, -weight[b]))[: max(TELLING, len(w) // TELLING)]].tolist()) for w, b in zip(of_words, of_bins, strict=True)]
    term_latent = vectors * weight[terms][:, None]
    lists = [w.tolist() for w in of_words]
    # Which passages each telling word belongs to; a match has need of them at least.
    need = np.array([np.ceil(MIN_ANSWER * len(a) - 1e-9) for a in answers], np.int64)
    lengths = n_words.astype(np.int64)
    pairs = [(x, j) for j, a in enumerate(answers) if lengths[j] >= MIN_WORDS for x in a]
    told, item_of = np.array([x for x, _ in pairs], np.uint64), np.array([j for _, j in pairs], np.int64)
    order = np.lexsort((item_of, told))
    item_of = item_of[order]
    told, told_at, told_n = np.unique(told[order], return_index=True, return_counts=True)
    may_tell = np.zeros(BINS, bool)
    may_tell[(told & np.uint64(BINS - 1)).astype(np.int64)] = True
    # A window, with as many words around it as the passage has.
    reach = SCALES[-1] + 2 * lengths

    def cosine_of(bins: np.ndarray, j: int) -> float:
        x = term_latent[row_of[bins[row_of[bins] >= 0]]].sum(axis=0)
        return float(x @ latent[j] / np.sqrt(max((weight[bins].astype(float) ** 2).sum(), 1e-9)))

    def check(out: list[dict[int, dict]], w: np.ndarray, bounds: np.ndarray, t: int, s: int, e: int, j: int, cosine: Callable[[], float]) -> None:
        """Compares passage j with the words s to e of text t and as many around them as the passage has."""
        n, found = len(lists[j]), out[t].get(j)
        if found and found["lcs"] >= 0.999:
            return
        near = w[max(bounds[t], s - n) : min(bounds[t + 1], e + n)].tolist()
        answer = len(answers[j].intersection(near)) / len(answers[j])
        if answer < MIN_ANSWER:
            return
        ratio = lcs(lists[j], near) / n
        if ratio >= MIN_LCS and (not found or ratio > found["lcs"]):
            out[t][j] = {"item_id": int(ids[j]), "cosine": cosine(), "lcs": ratio, "answer": answer}

    def search(texts: list[str], table: np.ndarray) -> list[list[dict]]:
        out: list[dict[int, dict]] = [{} for _ in texts]
        w, b, of = bins_of(texts, table)
        said = np.flatnonzero(may_tell[b])
        which = np.minimum(np.searchsorted(told, w[said]), len(told) - 1)
        said, which = said[told[which] == w[said]], which[told[which] == w[said]]
        n_said = told_n[which]
        item = item_of[np.repeat(told_at[which] - np.cumsum(n_said) + n_said, n_said) + np.arange(n_said.sum())]
        # Where telling words are, by passage and place.
        size = len(w) + 1
        places = np.sort(item * size + np.repeat(said, n_said))
        item, s = places // size, places % size
        # A region begins with a telling word, and has as many within reach as a match needs.
        last = np.arange(len(places)) + need[item] - 1
        far = places[np.minimum(last, len(places) - 1)]
        e = far % size
        m = (last < len(places)) & (far // size == item) & (e - s <= reach[item])
        m[m] = of[e[m]] == of[s[m]]
        if not m.any():
            return [[] for _ in texts]
        item, s, e, t = item[m], s[m], e[m], of[s[m]]
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))

        def enough(j: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """Whether the words lo to hi can have enough telling words of the passages j."""
            return np.searchsorted(places, j * size + hi) - np.searchsorted(places, j * size + lo) >= need[j]

        # Windows are sums of units of UNIT words; each text begins a unit. Every window that can have a region's telling words
        # in reach lies in the units around the region.
        n_units = -(-np.diff(bounds) // UNIT)
        first_unit = np.concatenate(([0], np.cumsum(n_units)))
        unit_of = lambda t, p: first_unit[t] + (p - bounds[t]) // UNIT
        around = lengths[item] + SCALES[-1]
        edge = np.zeros(first_unit[-1] + 1, np.int64)
        np.add.at(edge, unit_of(t, np.maximum(np.minimum(e - around, s), bounds[t])), 1)
        np.add.at(edge, unit_of(t, np.minimum(np.maximum(s + around, e), bounds[t + 1] - 1)) + 1, -1)
        live = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        in_text = np.searchsorted(first_unit, live, "right") - 1
        at = live - first_unit[in_text]
        start = bounds[in_text] + at * UNIT
        stop = np.minimum(start + UNIT, bounds[in_text + 1])
        words_in = np.repeat(start - np.cumsum(stop - start) + stop - start, stop - start) + np.arange((stop - start).sum())
        unit = np.repeat(np.arange(len(live)), stop - start)
        known = row_of[b[words_in]] >= 0
        vectors_of = _sums(unit[known], term_latent[row_of[b[words_in[known]]]], len(live))
        mass = np.concatenate(([0.0], np.cumsum(weight[b].astype(float) ** 2)))
        likely = np.unique(item)
        for j0 in range(0, len(likely), TILE):
            js = likely[j0 : j0 + TILE]
            dots = vectors_of @ latent[js].T
            for length in SCALES:
                # Two windows of half the length, the second within the same text.
                k = length // UNIT // 2
                second = np.minimum(np.searchsorted(live, live + k), len(live) - 1)
                rows = np.flatnonzero((live[second] == live + k) & (in_text[second] == in_text))
                whole = dots.copy()
                whole[rows] += dots[second[rows]]
                dots = whole
                used = np.flatnonzero(at % k == 0)
                lo, hi = start[used], np.minimum(start[used] + length, bounds[in_text[used] + 1])
                root = np.sqrt(np.maximum(mass[hi] - mass[lo], 1e-9)).astype(np.float32)
                i, j = np.nonzero(dots[used] >= MIN_COSINE * root[:, None])
                of_i, of_j = in_text[used[i]], js[j]
                near = enough(of_j, np.maximum(lo[i] - lengths[of_j], bounds[of_i]), np.minimum(hi[i] + lengths[of_j], bounds[of_i + 1]))
                for i, j in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    check(out, w, bounds, int(in_text[used[i]]), int(lo[i]), int(hi[i]), int(js[j]), lambda i=i, j=j: float(dots[used[i], j] / root[i]))
        # What the latent vectors miss, exactly: a match begins with some telling word, and enough others follow.
        m = enough(item, s, np.minimum(s + 2 * lengths[item], bounds[t + 1]))
        latent_found = [set(x) for x in out]
        for j, s, t in zip(item[m].tolist(), s[m].tolist(), t[m].tolist(), strict=True):
            if j not in latent_found[t]:
                e = min(s + len(lists[j]), int(bounds[t + 1]))
                check(out, w, bounds, t, s, e, j, lambda s=s, e=e, j=j: cosine_of(b[s:e], j))
        return [[m[j] for j in sorted(m)] for m in out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = word_table()
        for b in batches:
            for first, texts in chunks(b[text_col]):
                out = b.iloc[first : first + len(texts)].copy()
                out["_matches"] = search(texts, table)
                yield out

    return docs.mapInPandas(run, schema)
