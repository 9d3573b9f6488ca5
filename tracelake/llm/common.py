"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where unset and all runs on one machine (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders of the tables staged inside each open ``scratch``.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were staged inside, but for those staged to be kept."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage, and survives lost executors.

    A ``scratch`` around deletes it at its end; if kept, that of the caller around does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_OPEN) > kept:
        _OPEN[-1 - kept].append(path)
    schema = df.schema
    df.write.parquet(path)
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def row_keys(docs: DataFrame, doc_id: str, text: str, name: str, to: str = "_doc") -> tuple[DataFrame, bool]:
    """docs with a key of each row, in the order of ids (null first), then texts; and whether it is other than the id.

    Ids that are all there and all different are the keys themselves. Else rows are numbered in a staged table.
    """
    key, digest, row = F.col(doc_id).cast("bigint"), free_name("_digest", docs), free_name("_row", docs)
    plain = docs.where(key.isNull()).limit(1).isEmpty() and docs.groupBy(key.alias("k")).count().where("count > 1").limit(1).isEmpty()
    if plain:
        return docs.withColumn(to, key), False
    ranked = docs.withColumn(digest, F.sha2(F.col(text).cast("binary"), 256)).withColumn(row, F.monotonically_increasing_id())
    ranked = ranked.orderBy(key.asc_nulls_first(), F.col(digest).asc_nulls_first(), row).drop(digest, row)
    return stage_table(ranked.withColumn(to, F.monotonically_increasing_id()), name), True


def sums_before(df: DataFrame, order: dict[str, Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with the sums (new name: of what) over all rows before each one in the ascending order of some values (name: value).

    Rows are dealt over tasks by range and summed there; one task sees the totals of the ranges alone.
    """
    ranges = stage_table(df.withColumns(order).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    # One row for each range.
    ends = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(ends), F.lit(0)).alias(f"_all_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(F.broadcast(totals), "_range").withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_all_{n}") for n, c in sums.items()})
    return out.select(*df.columns, *sums)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of queries that are over: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of stage_table that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def free_name(name: str, docs: DataFrame) -> str:
    """name, or with underscores behind it, such that docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds value once and evaluates body over it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """Code points of text that are one of chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get texts in batches of so many rows, which bounds their memory where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
