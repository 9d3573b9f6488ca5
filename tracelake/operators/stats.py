"""Grouped statistics and the overview, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def key_of(by: str) -> Column:
    if by == "type":
        return F.col("type")
    if by == "parser":
        return F.concat(F.coalesce("parser_name", F.lit("")), F.lit("/"), F.coalesce("parser_version", F.lit("")))
    if by == "artifact":
        return F.col("artifact_id")
    if by == "deleted":
        return F.when(F.col("recovered"), "recovered").when(F.col("deleted"), "deleted").otherwise("live")
    if by == "run":
        return F.coalesce("ingest_id", F.lit(""))
    raise ValueError(by)


def stats(recs: DataFrame, by: str) -> DataFrame:
    """key, n, first_ts, last_ts in key order."""
    return recs.groupBy(key_of(by).alias("key")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy("key")


def overview(recs: DataFrame) -> DataFrame:
    some = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))
    return recs.agg(F.count("*").alias("n"), some(F.col("deleted")).alias("deleted"), some(F.col("recovered")).alias("recovered"), some(F.col("ts").isNull()).alias("untimed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def overview_and_types(recs: DataFrame) -> DataFrame:
    """The overview (type null) and the rows of each type, by one rollup."""
    return recs.rollup("type").agg(F.count("*").alias("n"), F.sum(F.col("ts").isNull().cast("bigint")).alias("untimed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def capped(groups: DataFrame, most: int) -> DataFrame:
    """The first groups by key (null first), and whether there are more: one sort of so many and one more."""
    first = groups.orderBy(F.col("key").asc_nulls_first()).limit(most + 1)
    rank = F.row_number().over(Window.orderBy(F.col("key").asc_nulls_first()))  # over most + 1 rows
    return first.withColumns({"_rank": rank, "more": F.count("*").over(Window.partitionBy()) > most}).where(F.col("_rank") <= most).drop("_rank")


def whole_overview(recs: DataFrame, hidden: DataFrame, runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """The overview with superseded records, gaps (rows of gaps) and runs by outcome as a map; hidden has (ingest_id, artifact_id).

    Hidden pairs are few: records are counted by pair first, and only these counts meet them.
    """
    by_pair = recs.groupBy("ingest_id", "artifact_id").agg(F.count("*").alias("n"))
    superseded = by_pair.join(hidden, ["ingest_id", "artifact_id"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("superseded"))
    outcomes = runs.groupBy("outcome").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    out = overview(recs)
    for one in (superseded, gaps.agg(F.count("*").alias("gaps")), outcomes):
        out = out.join(one, F.lit(True))  # rows of single aggregates
    return out
