"""A postings index that grows with a stream of records: the postings of each micro-batch, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.search import postings


def index_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the postings of a stream of records (id, summary, body) under out, by micro-batch, sorted by term.

    A micro-batch that is tried again overwrites its own folder, so no posting comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{out}/batch_no={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    """The postings of all micro-batches, as the searches take them."""
    return spark.read.parquet(out).drop("batch_no")
