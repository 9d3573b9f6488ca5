"""Audited append: dense record ids, a log of entries chained by hash, and batches that become visible whole.

An ingest goes through ``STEPS``, each of which is on disk before the next begins:

* start: an entry of the log with the first id that the ingest will give;
* rows: the records with their ids, in the order of a key: partitions are numbered by their counts, so no task sees all rows;
* digests: for each batch of ids its count and digest, from the rows as they were read back;
* end: an entry with the number of rows and a digest over the batches;
* commit: a marker. ``visible`` gives the rows of ingests that have one, and no others.

Whatever step was the last before a crash, ``interrupted`` names it, and appending the same ingest again completes it from there
with the same ids; ``abandon`` gives it up with its ids unused. Until one of both, no other ingest starts, so ids have no gaps. One
writer at a time works on a folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.integrity import row_digest

from .staging import staged

STEPS = ("start", "rows", "digests", "end", "commit")
ENTRY = "seq bigint, kind string, ingest string, first_id bigint, n bigint, digest string, prev string, hash string"
FIRST = "0" * 64


class Unfinished(RuntimeError):
    """Another ingest was interrupted and is neither completed nor abandoned."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a write to that folder was committed."""
    return _exists(spark, f"{path}/_SUCCESS")


def entry_hash(prev: Column) -> Column:
    """The hash of an entry of the log: of the one before and of all that it says."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seq", "kind", "ingest", "first_id", "n", "digest")]
    return F.sha2(F.concat_ws("|", prev, *said), 256)


def log(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the log."""
    return spark.read.schema(ENTRY).parquet(f"{path}/log/*") if _exists(spark, f"{path}/log") else spark.createDataFrame([], ENTRY)


def _write_entry(spark: SparkSession, path: str, kind: str, ingest: str, first_id: int, n: int, digest: str | None) -> None:
    last = log(spark, path).orderBy(F.desc("seq")).limit(1).first()
    seq, prev = (last["seq"] + 1, last["hash"]) if last else (1, FIRST)
    said = spark.createDataFrame([(seq, kind, ingest, first_id, n, digest, prev)], ENTRY.rsplit(", ", 1)[0])
    # Two writers can't take one number.
    said.withColumn("hash", entry_hash(F.col("prev"))).coalesce(1).write.mode("overwrite" if not _done(spark, f"{path}/log/{seq}") else "error").parquet(f"{path}/log/{seq}")


def chain_faults(entries: DataFrame) -> DataFrame:
    """seq, fault of entries that break the chain: gap in the numbers, prev (not the hash before), hash (not that of what it says)."""
    order = Window.orderBy("seq")  # two entries for an ingest
    before = entries.withColumns({"_seq": F.coalesce(F.lag("seq").over(order), F.lit(0)), "_hash": F.coalesce(F.lag("hash").over(order), F.lit(FIRST))})
    fault = F.when(F.col("seq") != F.col("_seq") + 1, "gap").when(F.col("prev") != F.col("_hash"), "prev").when(F.col("hash") != entry_hash(F.col("prev")), "hash")
    return before.select("seq", fault.alias("fault")).where("fault IS NOT NULL")


def numbered(recs: DataFrame, key: list[str], first_id: int) -> DataFrame:
    """recs with ``id``: dense numbers from first_id on in the order of key."""
    rows = staged(recs.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()), "append-rows")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_part").alias("_of"), before.alias("_before"))
    return rows.join(F.broadcast(counts), F.col("_part") == F.col("_of")).select((F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + first_id).alias("id"), *recs.columns)


def append_steps(spark: SparkSession, path: str, ingest: str, recs: DataFrame, key: list[str], batch_rows: int = 5000) -> Iterator[str]:
    """Appends an ingest; gives the name of each step once it is on disk. Steps that an earlier try has done aren't done again."""
    own = log(spark, path).where(F.col("ingest") == ingest)
    kinds = {r["kind"]: r for r in own.collect()}  # two entries
    if _done(spark, f"{path}/commits/{ingest}"):
        return
    if "start" not in kinds or "abort" in kinds:
        if open_ := [r["ingest"] for r in interrupted(spark, path).collect()]:
            raise Unfinished(f"complete or abandon {', '.join(open_)} first")
        if "abort" in kinds:
            raise ValueError(f"{ingest}: was abandoned; take another name")
        last = log(spark, path).where("kind = 'end'").agg(F.max(F.col("first_id") + F.col("n"))).first()[0]
        _write_entry(spark, path, "start", ingest, last or 1, 0, None)
        yield "start"
    first_id = log(spark, path).where((F.col("ingest") == ingest) & (F.col("kind") == "start")).first()["first_id"]
    at, digests = f"{path}/records/{ingest}", f"{path}/digests/{ingest}"
    if not _done(spark, at):
        batch = F.floor((F.col("id") - first_id) / batch_rows)
        numbered(recs, key, first_id).withColumn("batch", batch).write.mode("overwrite").parquet(at)
        yield "rows"
    if not _done(spark, digests):
        rows = spark.read.parquet(at)
        each = rows.select("batch", "id", row_digest(["id", *recs.columns]).alias("d"))
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "d"))), lambda x: x["d"]), "")
        each.groupBy("batch").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.sha2(ordered, 256).alias("digest")).write.mode("overwrite").parquet(digests)
        yield "digests"
    if "end" not in kinds:
        whole = spark.read.parquet(digests).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.coalesce(F.sum(F.xxhash64("batch", "digest").cast("decimal(38,0)")).cast("string"), F.lit("")), 256).alias("digest")).first()
        _write_entry(spark, path, "end", ingest, first_id, whole["n"], whole["digest"])
        yield "end"
    spark.createDataFrame([(ingest, first_id)], "ingest string, first_id bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{ingest}")
    yield "commit"


def append(spark: SparkSession, path: str, ingest: str, recs: DataFrame, key: list[str], batch_rows: int = 5000) -> None:
    """Appends an ingest, or completes one that was interrupted."""
    for _ in append_steps(spark, path, ingest, recs, key, batch_rows):
        pass


def abandon(spark: SparkSession, path: str, ingest: str) -> None:
    """Gives up an interrupted ingest: its rows stay invisible, its ids go to the next one."""
    state = {r["ingest"]: r["last_step"] for r in interrupted(spark, path).collect()}
    if ingest not in state or state[ingest] == "end":
        raise ValueError(f"{ingest}: {'ended, append it again to commit it' if ingest in state else 'not interrupted'}")
    _write_entry(spark, path, "abort", ingest, 0, 0, None)


def interrupted(spark: SparkSession, path: str) -> DataFrame:
    """ingest, last_step of ingests that have started and are neither committed nor abandoned."""
    kinds = log(spark, path).groupBy("ingest").agg(F.collect_set("kind").alias("kinds")).collect()
    rows = []
    for r in kinds:  # a few for each folder: finished ingests are told by their markers
        if "abort" not in r["kinds"] and not _done(spark, f"{path}/commits/{r['ingest']}"):
            done = [s for s, at in (("rows", "records"), ("digests", "digests")) if _done(spark, f"{path}/{at}/{r['ingest']}")]
            rows.append((r["ingest"], "end" if "end" in r["kinds"] else done[-1] if done else "start"))
    return spark.createDataFrame(rows, "ingest string, last_step string")


def visible(spark: SparkSession, path: str) -> DataFrame:
    """ingest and the records of all committed ingests."""
    names = [r["ingest"] for r in spark.read.parquet(f"{path}/commits/*").select("ingest").collect()] if _exists(spark, f"{path}/commits") else []
    out = None
    for n in names:
        one = spark.read.parquet(f"{path}/records/{n}").withColumn("ingest", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"{path}: nothing is committed")
    return out


def batch_faults(spark: SparkSession, path: str) -> DataFrame:
    """ingest, batch, state of batches of committed ingests whose rows don't give their digest: missing, unexpected or differs."""
    rows = visible(spark, path)
    columns = [c for c in rows.columns if c not in ("ingest", "batch")]
    each = rows.select("ingest", "batch", "id", row_digest(columns).alias("d"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "d"))), lambda x: x["d"]), "")
    now = each.groupBy("ingest", "batch").agg(F.sha2(ordered, 256).alias("_now"))
    told = spark.read.parquet(f"{path}/digests/*").withColumn("ingest", F.element_at(F.split(F.input_file_name(), "/"), -2)).select("ingest", "batch", "digest")
    told = told.join(rows.select("ingest").distinct(), "ingest", "left_semi")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").when(F.col("_now") != F.col("digest"), "differs")
    return told.join(now, ["ingest", "batch"], "full").select("ingest", "batch", state.alias("state")).where("state IS NOT NULL")
