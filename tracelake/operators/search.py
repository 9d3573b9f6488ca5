"""Full-text search over a stored postings index: terms, phrases, prefixes, substrings, relevance, term hits, snippets.

A query is given as data: groups of items, any of which groups must match; a row matches a group if it has all its
positive items and none of its negative ones. Postings answer it in one pass, as a set of ids that joins any list, count
or statistic of the records (``matching``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.fold import VERSION, fold, folded, folded_map, normalise, normalised, tokens, trigrams, words
from tracelake.operators import localise
from tracelake.sources.staging import staged

WEIGHTS = {"summary": 2.0, "body": 1.0}
COLUMNS = tuple(WEIGHTS)
#: Limits of a query: bytes, items, bytes of a term, letters of a prefix, characters of a substring, literal terms, ids of each.
MAX_QUERY, MAX_ITEMS, MAX_TERM, MIN_PREFIX, MIN_SUBSTRING, MAX_LITERALS, MAX_IDS, MAX_RANK = 4096, 64, 256, 2, 3, 1000, 100_000, 1000
K1, B = 1.2, 0.75


class InvalidQuery(ValueError):
    """A query outside the limits."""


def quoted(text: str, most: int = 32) -> str:
    """A text for a message: at most so many characters, all but printable ASCII escaped."""
    shown = "".join(c if " " <= c <= "~" and c not in "\"\\" else c.encode("unicode_escape").decode() if c not in "\"\\" else "\\" + c for c in text[:most])
    return f'"{shown}"' + ("..." if len(text) > most else "")


@dataclass(frozen=True)
class Item:
    """Words next to each other; prefix: the last word is only begun; negative: must be absent."""

    words: tuple[str, ...]
    prefix: bool = False
    negative: bool = False


def item(text: str, prefix: bool = False, negative: bool = False) -> Item:
    """An item of a text's words, normalised as the index is."""
    if len(text.encode()) > MAX_TERM:
        raise InvalidQuery(f"a term of more than {MAX_TERM} bytes: {quoted(text)}")
    found = words(text)
    if not found:
        raise InvalidQuery(f"no word in {quoted(text)}")
    if prefix and len(found[-1]) < MIN_PREFIX:
        raise InvalidQuery(f"a prefix of fewer than {MIN_PREFIX} letters: {quoted(text)}")
    return Item(found, prefix, negative)


def checked(groups: Sequence[Sequence[Item]]) -> list[list[Item]]:
    if not groups or any(all(i.negative for i in g) for g in groups):
        raise InvalidQuery("every group needs a positive term")
    if sum(len(g) for g in groups) > MAX_ITEMS:
        raise InvalidQuery(f"more than {MAX_ITEMS} terms")
    if sum(len(w.encode()) for g in groups for i in g for w in i.words) > MAX_QUERY:
        raise InvalidQuery(f"more than {MAX_QUERY} bytes")
    return [list(g) for g in groups]


# The index.


def postings(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "id", full: bool = True) -> DataFrame:
    """id, col, pos, term of every word; full: normalised first (else folded only, without Python)."""
    out = None
    for c in columns:
        text = normalised(F.col(c)) if full else F.col(c)
        part = docs.where(F.col(c).isNotNull()).select(F.col(key).alias("id"), F.lit(c).alias("col"), text.alias("_t")).select("id", "col", F.posexplode(tokens(F.col("_t"))).alias("pos", "term"))
        out = part if out is None else out.union(part)
    return out


def trigram_postings(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "id") -> DataFrame:
    """id, col, gram: the different trigrams of every text."""
    out = None
    for c in columns:
        part = docs.where(F.col(c).isNotNull()).select(F.col(key).alias("id"), F.lit(c).alias("col"), F.explode(F.array_distinct(trigrams(F.col(c)))).alias("gram"))
        out = part if out is None else out.union(part)
    return out


def build_index(recs: DataFrame, path: str, chunk_rows: int = 1_000_000, only: Sequence[int] | None = None) -> None:
    """Writes the postings of records under path, by chunks of ids, each sorted by term; a chunk written again replaces itself."""
    part = postings(recs).withColumn("chunk", F.floor((F.col("id") - 1) / chunk_rows))
    part = part if only is None else part.where(F.col("chunk").isin(*only))
    # Files hold ranges of terms, so that a chunk is many tasks' work and a query opens only the files and row groups of its terms.
    part.repartitionByRange("chunk", "term", "id").sortWithinPartitions("chunk", "term", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{path}/postings")
    spark = recs.sparkSession
    stored = spark.read.parquet(f"{path}/postings")
    stored = stored if only is None else stored.where(F.col("chunk").isin(*only))
    # How long each record is in each column, and for each chunk how many records have which columns.
    lengths = stored.groupBy("chunk", "id").agg(*[F.count_if(F.col("col") == c).alias(f"len_{c}") for c in COLUMNS])
    lengths.repartitionByRange("chunk", "id").sortWithinPartitions("chunk", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    totals = lengths.groupBy(F.col("chunk"), *[(F.col(f"len_{c}") > 0).alias(f"has_{c}") for c in COLUMNS]).agg(F.count("*").alias("n"), *[F.sum(f"len_{c}").alias(f"all_{c}") for c in COLUMNS])
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    spark.createDataFrame([(VERSION, chunk_rows)], "version string, chunk_rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings").drop("chunk")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def missing_chunks(recs: DataFrame, path: str, chunk_rows: int = 1_000_000) -> DataFrame:
    """chunk: those with words that the index lacks."""
    spark = recs.sparkSession
    want = recs.where(" OR ".join(f"{c} RLIKE '[\\\\p{{L}}\\\\p{{N}}]'" for c in COLUMNS)).select(F.floor((F.col("id") - 1) / chunk_rows).alias("chunk")).distinct()
    if not _exists(spark, f"{path}/postings"):
        return want
    return want.join(spark.read.parquet(f"{path}/postings").select(F.col("chunk").cast("long").alias("chunk")).distinct(), "chunk", "left_anti")


def index_state(recs: DataFrame, path: str) -> str:
    """unbuilt, stale (other rules), building (chunks are missing) or current."""
    spark = recs.sparkSession
    if not _exists(spark, f"{path}/state"):
        return "building" if _exists(spark, f"{path}/postings") else "unbuilt"
    state = spark.read.parquet(f"{path}/state").first()
    if state["version"] != VERSION:
        return "stale"
    return "current" if missing_chunks(recs, path, state["chunk_rows"]).isEmpty() else "building"


def reindex(recs: DataFrame, path: str, chunk_rows: int = 1_000_000) -> list[int]:
    """Builds what is missing, all if the rules have changed; gives the chunks written. Can be stopped and called again."""
    if index_state(recs, path) == "stale":
        build_index(recs, path, chunk_rows)
        return sorted(r["chunk"] for r in recs.select(F.floor((F.col("id") - 1) / chunk_rows).alias("chunk")).distinct().collect())
    todo = sorted(r["chunk"] for r in missing_chunks(recs, path, chunk_rows).collect())  # numbers of chunks, a millionth of the rows
    if todo:
        build_index(recs, path, chunk_rows, todo)
    return todo


def docs_per_column(index: DataFrame) -> DataFrame:
    """col, docs, terms: how many records have words in each column, and how many words."""
    return index.groupBy("col", "id").agg(F.count("*").alias("k")).groupBy("col").agg(F.count("*").alias("docs"), F.sum("k").alias("terms"))


def postings_digest(index: DataFrame, key: str, batch_rows: int) -> DataFrame:
    """batch_no, n, digest: a keyed sum over each batch's postings, the same in any order."""
    mac = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), "id", "col", "pos", "term")), 1, 15), 16, 10).cast("decimal(38,0)")
    return index.groupBy(F.floor((F.col("id") - 1) / batch_rows).alias("batch_no")).agg(F.count("*").alias("n"), F.sum(mac).cast("decimal(38,0)").alias("digest"))


def index_proof(index: DataFrame, recs: DataFrame, key: str, batch_rows: int, full: bool = True) -> DataFrame:
    """batch_no, state: equal, differs, missing (records have words, the index hasn't) or extra."""
    one = postings_digest(index, key, batch_rows).withColumnRenamed("digest", "_i").drop("n")
    two = postings_digest(postings(recs, full=full), key, batch_rows).withColumnRenamed("digest", "_r").drop("n")
    state = F.when(F.col("_i").isNull(), "missing").when(F.col("_r").isNull(), "extra").when(F.col("_i") == F.col("_r"), "equal").otherwise("differs")
    return one.join(two, "batch_no", "full").select("batch_no", state.alias("state"))


def index_faults(index: DataFrame, recs: DataFrame, full: bool = True) -> DataFrame:
    """id, state of records whose postings differ from those in the index: missing, extra or differs; found by sums of id ranges."""
    columns = ["col", "pos", "term"]
    sides = [staged(side, "postings-side") for side in (index.select("id", *columns), postings(recs, full=full))]
    kept = [staged(localise.sums(side, "id", columns), "postings-sums") for side in sides]
    return localise.differing(sides[0], kept[0], sides[1], kept[1], "id", columns)


# Queries.


def _hits(index: DataFrame, items: Sequence[Item], columns: Sequence[str]) -> DataFrame:
    """id, col, item: where each item is. A word's place less its place in the item is where the item begins."""
    term, found, wanted = F.col("term"), [], F.lit(False)
    for n, i in enumerate(items):
        for k, w in enumerate(i.words):
            is_it = F.startswith(term, F.lit(w)) if i.prefix and k == len(i.words) - 1 else term == w
            wanted = wanted | is_it
            found.append(F.when(is_it, F.struct(F.lit(n).alias("item"), F.lit(k).alias("k"))))
    some = index.where(F.col("col").isin(*columns) & wanted).select("id", "col", "pos", F.explode(F.array_compact(F.array(*found))).alias("f"))
    sizes = F.element_at(F.array(*[F.lit(len(i.words)) for i in items]), F.col("item") + 1)
    at = some.select("id", "col", "f.item", "f.k", (F.col("pos") - F.col("f.k")).alias("at"))
    return at.groupBy("id", "col", "item", "at").agg(F.count_distinct("k").alias("n")).where(F.col("n") == sizes)


def match_ids(index: DataFrame, groups: Sequence[Sequence[Item]], columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The ids that match, by one pass over the postings of the query's words."""
    groups = checked(groups)
    items = list(dict.fromkeys(Item(i.words, i.prefix) for g in groups for i in g))
    number = {i: n for n, i in enumerate(items)}
    has = _hits(index, items, columns).groupBy("id").agg(F.collect_set("item").alias("has"))
    any_group = F.lit(False)
    for g in groups:
        all_items = F.lit(True)
        for i in g:
            hit = F.array_contains("has", number[Item(i.words, i.prefix)])
            all_items = all_items & (~hit if i.negative else hit)
        any_group = any_group | all_items
    return has.where(any_group).select("id")


def matching(recs: DataFrame, index: DataFrame, groups: Sequence[Sequence[Item]], columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The records that match; goes before any list, count or statistic."""
    return recs.join(match_ids(index, groups, columns), "id", "left_semi")


def substring(docs: DataFrame, needle: str, columns: Sequence[str] = COLUMNS, grams: DataFrame | None = None) -> DataFrame:
    """The rows that hold a text; with a trigram index only rows with all its trigrams are looked at."""
    wanted = fold(needle)
    if len(wanted) < MIN_SUBSTRING:
        raise InvalidQuery(f"fewer than {MIN_SUBSTRING} characters: {quoted(needle)}")
    if grams is not None:
        parts = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
        likely = grams.where(F.col("gram").isin(*parts) & F.col("col").isin(*columns)).groupBy("id", "col").agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(parts))
        docs = docs.join(likely, "id", "left_semi")
    return docs.where(_contains(wanted, columns))


def _contains(wanted: str, columns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(folded(F.col(c)), F.lit(wanted))
    return hit


def scan(docs: DataFrame, needle: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One row: scanned, found and found in each column, of a search without an index by a text of any length."""
    wanted = fold(needle)
    each = {c: F.contains(folded(F.col(c)), F.lit(wanted)) for c in columns}
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return docs.agg(F.count("*").alias("scanned"), count(_contains(wanted, columns)).alias("found"), *[count(x).alias(f"found_{c}") for c, x in each.items()])


def term_hits(index: DataFrame, terms: Sequence[str], ids: int = 0, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """term, n (records with the term) and the first ids of these, ascending; terms without any stay."""
    if len(terms) > MAX_LITERALS or ids > MAX_IDS:
        raise InvalidQuery(f"more than {MAX_LITERALS} terms or {MAX_IDS} ids")
    wanted = index.sparkSession.createDataFrame([(t, " ".join(words(t))) for t in dict.fromkeys(terms)], "term string, _word string")
    found = index.where(F.col("term").isin(*{" ".join(words(t)) for t in terms}) & F.col("col").isin(*columns)).select(F.col("term").alias("_word"), "id").distinct()
    if not ids:
        counted = found.groupBy("_word").agg(F.count("*").alias("n"))
        return wanted.join(counted, "_word", "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("_word")
    # The hits are read once: a word's count is its last rank.
    ranked_ = found.withColumn("_r", F.row_number().over(Window.partitionBy("_word").orderBy("id")).cast("bigint"))
    counted = ranked_.groupBy("_word").agg(F.max("_r").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= ids, F.col("id")))).alias("ids"))
    out = wanted.join(counted, "_word", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "ids": F.coalesce("ids", F.array().cast("array<bigint>"))})
    return out.drop("_word")


def ranked(index: DataFrame, terms: Sequence[str], k: int, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """id, score of the k best records that have all terms, by BM25 over all weighted columns; smaller is better, ties by id."""
    if not 0 < k <= MAX_RANK:
        raise InvalidQuery(f"a limit outside 1 to {MAX_RANK}")
    wanted = [w for t in dict.fromkeys(terms) for w in item(t).words]
    weight = F.element_at(F.create_map(*[F.lit(x) for c, v in weights.items() for x in (c, v)]), F.col("col"))
    counts = index.where(F.col("col").isin(*weights)).groupBy("id").agg(
        F.count("*").alias("len"), *[F.sum(F.when(F.col("term") == w, weight).otherwise(0.0)).alias(f"tf{i}") for i, w in enumerate(wanted)]
    )
    total = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    # One row, joined to those with all terms; the plan stays one job.
    some = counts.where(" AND ".join(f"tf{i} > 0" for i in range(len(wanted)))).withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    score = F.lit(0.0)
    for i in range(len(wanted)):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return some.select("id", score.alias("score")).orderBy("score", "id").limit(k)


def ranked_stored(spark: SparkSession, path: str, terms: Sequence[str], k: int, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """What ``ranked`` gives, from a stored index: its terms' postings, the lengths of the records that have them all, and the totals."""
    if not 0 < k <= MAX_RANK:
        raise InvalidQuery(f"a limit outside 1 to {MAX_RANK}")
    wanted = [w for t in dict.fromkeys(terms) for w in item(t).words]
    weight = F.element_at(F.create_map(*[F.lit(x) for c, v in weights.items() for x in (c, v)]), F.col("col"))
    own = read_index(spark, path).where(F.col("term").isin(*wanted) & F.col("col").isin(*weights))
    counts = own.groupBy("id").agg(*[F.sum(F.when(F.col("term") == w, weight).otherwise(0.0)).alias(f"tf{i}") for i, w in enumerate(wanted)])
    found = counts.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    size = sum((F.col(f"all_{c}") for c in weights), F.lit(0))
    holds = F.lit(False)
    for c in weights:
        holds = holds | F.col(f"has_{c}")
    total = spark.read.parquet(f"{path}/totals").where(holds).agg(F.sum("n").alias("n"), (F.sum(size) / F.sum("n")).alias("avg")).join(found)
    some = counts.where(" AND ".join(f"tf{i} > 0" for i in range(len(wanted))))
    lengths = spark.read.parquet(f"{path}/lengths").select("id", sum((F.col(f"len_{c}") for c in weights), F.lit(0)).alias("len"))
    some = some.join(lengths, "id").join(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return some.select("id", score.alias("score")).orderBy("score", "id").limit(k)


def exact_snippet(text: Column, needle: str, width: int = 120) -> Column:
    """struct(text, spans): width characters of the original that begin a quarter before the first hit, and start and length of the hits that lie in it whole.

    Hits are found in the folded text and carried back by its map of positions: marks, expansions and ligatures count as the
    characters that stand in the text. Null without a hit.
    """
    if not 20 <= width <= 400:
        raise InvalidQuery("a width outside 20 to 400")
    wanted = "".join(c for c, _ in folded_map(needle))

    @F.pandas_udf("struct<text: string, spans: array<struct<start: int, length: int>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, wanted, width) for t in texts], columns=["text", "spans"])

    out = run(text)
    return F.when(out["text"].isNotNull(), out)


def cut(text: str | None, wanted: str, width: int) -> tuple:
    """What exact_snippet gives for one text."""
    text = text or ""
    found = [] if text.isascii() else folded_map(text)
    flat = text.lower() if text.isascii() else "".join(c for c, _ in found)
    place = range(len(text)) if text.isascii() else [p for _, p in found]
    at = flat.find(wanted) if wanted else -1
    if at < 0:
        return None, None
    spans, start = [], max(0, place[at] - width // 4)
    while at >= 0:
        a, z = place[at], place[at + len(wanted) - 1] + 1
        while z < len(text) and unicodedata.combining(text[z]):  # marks belong to the letter before them
            z += 1
        if z > start + width:
            break
        spans.append((a - start, z - a))
        at = flat.find(wanted, at + len(wanted))
    return text[start : start + width], spans


def snippet(text: Column, needle: str, width: int = 120) -> Column:
    """struct(text, at): width code points that begin a quarter before the first hit, and where in them hits begin (from 0); null without one."""
    if not 20 <= width <= 400:
        raise InvalidQuery("a width outside 20 to 400")
    wanted = fold(needle)
    t = F.coalesce(text, F.lit(""))
    # Folding keeps the number of characters as long as no mark is dropped; texts with marks are searched in lower case alone.
    flat = F.when(F.length(folded(t)) == F.length(t), folded(t)).otherwise(F.lower(t))
    at = F.instr(flat, F.lit(wanted))
    start = F.greatest(F.lit(1), at - width // 4)
    window = F.substring(flat, start, F.lit(width))
    pieces = F.split(window, F.lit("\\Q" + wanted.replace("\\E", "\\E\\\\E\\Q") + "\\E"), -1)
    step = lambda a, p: F.struct((a["at"] + F.length(p) + len(wanted)).cast("int").alias("at"), F.concat(a["out"], F.array((a["at"] + F.length(p)).cast("int"))).alias("out"))
    begun = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])
    return F.when(at > 0, F.struct(F.substring(t, start, F.lit(width)).alias("text"), begun.alias("at")))


__all__ = ["Item", "InvalidQuery", "build_index", "item", "matching", "match_ids", "normalise", "postings", "ranked", "ranked_stored", "exact_snippet", "snippet", "substring", "term_hits"]
