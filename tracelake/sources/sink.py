"""Append-only storage of records: batches with digests, and what an interrupted ingest left."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.integrity import batch_digest


def append(recs: DataFrame, path: str, ingest_id: str, columns: list[str], batch_rows: int = 5000) -> DataFrame:
    """Writes an ingest's records under path by type, and the digests of its batches; a repeated ingest replaces itself.

    Gives the digests as stored. The rows are read back before they are digested, so that a digest is of what was written.
    """
    spark, at = recs.sparkSession, f"ingest_id={ingest_id}"
    recs.drop("ingest_id").write.mode("overwrite").partitionBy("type").parquet(f"{path}/records/{at}")
    stored = spark.read.schema(recs.drop("ingest_id").schema).parquet(f"{path}/records/{at}")
    batch_digest(stored, columns, batch_rows).write.mode("overwrite").parquet(f"{path}/batches/{at}")
    return spark.read.parquet(f"{path}/batches/{at}")


def unresolved(audited: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Batches of only one side: audited but not stored, or stored but not audited."""
    return audited.join(stored, keys, "left_anti").select(*keys, F.lit("not stored").alias("state")).unionByName(stored.join(audited, keys, "left_anti").select(*keys, F.lit("not audited").alias("state")))


def census(table: DataFrame, counted: Mapping[str, Column]) -> DataFrame:
    """One row: n and the number of rows that meet each condition, in one pass."""
    return table.agg(F.count("*").alias("n"), *[F.coalesce(F.count_if(c), F.lit(0)).alias(name) for name, c in counted.items()])


def order_violations(scan: DataFrame, part: str, position: str, key: str) -> DataFrame:
    """Rows of a scan whose key isn't greater than the one before; state: equal, descends, or undecided beside a null."""
    before = F.lag(key).over(Window.partitionBy(part).orderBy(position))
    first = F.row_number().over(Window.partitionBy(part).orderBy(position)) == 1
    out = scan.withColumns({"_before": before, "_first": first})
    state = F.when(F.col("_before").isNull() | F.col(key).isNull(), "undecided").when(F.col("_before") == F.col(key), "equal").when(F.col("_before") > F.col(key), "descends")
    return out.where("NOT _first").withColumn("state", state).where("state IS NOT NULL").drop("_before", "_first")


def ingest(recs: DataFrame, path: str, ingest_id: str, wrong: Column, columns: list[str], batch_rows: int = 5000, most_wrong: float = 0.5) -> DataFrame:
    """Writes an ingest's records with an audit log: what is wrong (a text, null if nothing is) is rejected and counted, not dropped in silence.

    Gives one row: ingest_id, outcome, accepted, rejected, batches. With more than most_wrong of the records rejected nothing is
    stored and the outcome is aborted. Start and end are entries of the log under path; a start without an end is what a crash leaves.
    """
    spark, at = recs.sparkSession, f"{path}/audit/ingest_id={ingest_id}"
    entry = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "*").coalesce(1).write.mode("append").json(at)
    entry("start", spark.range(1).select(F.lit(ingest_id).alias("ingest")))
    checked = recs.withColumn("_wrong", wrong)
    count = checked.agg(F.count_if(F.col("_wrong").isNull()).alias("accepted"), F.count_if(F.col("_wrong").isNotNull()).alias("rejected")).first()
    good, bad = count["accepted"], count["rejected"]
    aborted = bad > most_wrong * (good + bad)
    batches = 0
    if not aborted:
        checked.where("_wrong IS NOT NULL").drop("ingest_id").write.mode("overwrite").parquet(f"{path}/rejected/ingest_id={ingest_id}")
        batches = append(checked.where("_wrong IS NULL").drop("_wrong"), path, ingest_id, columns, batch_rows).count()
    out = spark.range(1).select(F.lit(ingest_id).alias("ingest_id"), F.lit("aborted" if aborted else "complete").alias("outcome"), F.lit(good).cast("bigint").alias("accepted"), F.lit(bad).cast("bigint").alias("rejected"), F.lit(batches).cast("bigint").alias("batches"))
    entry("end", out.drop("ingest_id"))
    return out


def interrupted(spark: SparkSession, path: str) -> DataFrame:
    """ingest_id of ingests whose log has a start without an end after it: their records are to be written again."""
    log = spark.read.json(f"{path}/audit")
    return log.groupBy("ingest_id").agg(F.count_if(F.col("kind") == "start").alias("starts"), F.count_if(F.col("kind") == "end").alias("ends")).where("starts > ends").select("ingest_id")
