"""Records as a stream: appended by micro-batch, with a digest of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of records to out, once each.

    A micro-batch is written to a folder of its own number and overwrites what an earlier try left there, so that a batch
    which is repeated after a failure doesn't repeat rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_no={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, out: str, columns: list[str]) -> DataFrame:
    """batch_no, n, first_id, last_id and a digest that doesn't depend on the rows' order: sums of hashes, pre-aggregated."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return spark.read.parquet(out).groupBy("batch_no").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(h).alias("digest"))


def event_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Records of each type in windows of their time; a window closes when the watermark passes it, later records are left out."""
    timed = stream.where("ts IS NOT NULL").withColumn("at", F.timestamp_micros("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")
