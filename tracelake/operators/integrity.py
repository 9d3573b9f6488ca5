"""Integrity checks as queries: chains, digests, set differences, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_digest(columns: list[str]) -> Column:
    """SHA-256 over length-prefixed values, nulls marked."""
    part = lambda c: F.when(F.col(c).isNull(), "0;").otherwise(F.concat(F.lit("1:"), F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def batch_digest(recs: DataFrame, columns: list[str], batch_rows: int = 5000) -> DataFrame:
    """batch_no, n, digest: rows in id order, in batches of ids."""
    rows = recs.select("id", F.floor((F.col("id") - 1) / batch_rows).alias("batch_no"), row_digest(columns).alias("d"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "d"))), lambda x: x["d"]), "")
    return rows.groupBy("batch_no").agg(F.count("*").alias("n"), F.sha2(ordered, 256).alias("digest"))


def chain_breaks(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Entries whose previous sequence number isn't one less."""
    before = F.lag(seq).over(Window.partitionBy(key).orderBy(seq))
    return log.withColumn("_before", before).where(F.col("_before").isNotNull() & (F.col(seq) != F.col("_before") + 1)).drop("_before")


def differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """side and row of what only one of them has, repeats counted: one aggregate of signed counts."""
    both = stored.withColumn("_n", F.lit(1)).unionByName(recomputed.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*stored.columns).agg(F.sum("_n").alias("_n")).where("_n != 0")
    side = F.when(F.col("_n") > 0, "stored").otherwise("recomputed")
    return left.select(*stored.columns, side.alias("side"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n"))).alias("_k")).drop("_k")


def overlaps(batches: DataFrame, key: str) -> DataFrame:
    """Batches (key, first_id, last_id) that begin before an earlier one ends."""
    before = F.max("last_id").over(Window.partitionBy(key).orderBy("first_id", "last_id").rowsBetween(Window.unboundedPreceding, -1))
    return batches.withColumn("_before", before).where("_before >= first_id").drop("_before")


def rollup(batches: DataFrame, key: str) -> DataFrame:
    """key, batches, digest over the digests of a key's batches (key, batch_no, digest) in order; a key's batches are a few thousand at most."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch_no", "digest"))), lambda x: x["digest"]), "")
    return batches.groupBy(key).agg(F.count("*").alias("batches"), F.sha2(ordered, 256).alias("digest"))
