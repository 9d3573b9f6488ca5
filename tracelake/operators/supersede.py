"""Supersession: a later complete run of a parser of the same name hides older runs' rows for the artifacts it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.records import parsers, runs


def covered_runs(coverage: DataFrame) -> DataFrame:
    spark = coverage.sparkSession
    return coverage.join(F.broadcast(runs(spark).join(parsers(spark), "parser_id")), "ingest_id")  # a few rows of runs


def superseded_pairs(coverage: DataFrame) -> DataFrame:
    """ingest_id, artifact_id that a later complete run of the same parser name covers: one aggregate, no self-join on pairs."""
    at = covered_runs(coverage)
    last = at.where("outcome = 'complete'").groupBy("parser_name", "artifact_id").agg(F.max("end_seq").alias("last"))
    return at.join(last, ["parser_name", "artifact_id"]).where("last > end_seq").select("ingest_id", "artifact_id").distinct()


def superseded_by(coverage: DataFrame) -> DataFrame:
    """ingest_id, artifact_id, by: the first later complete run."""
    at = covered_runs(coverage)
    after = Window.partitionBy("parser_name", "artifact_id").orderBy("end_seq").rowsBetween(1, Window.unboundedFollowing)
    by = F.min(F.when(F.col("outcome") == "complete", F.struct("end_seq", "ingest_id"))).over(after)
    return at.withColumn("_by", by).where("_by IS NOT NULL").select("ingest_id", "artifact_id", F.col("_by.ingest_id").alias("by"))
