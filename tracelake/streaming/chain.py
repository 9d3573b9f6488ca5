"""A hash chain verified as its entries stream in: state of each chain is its last number and hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracelake.sources.append import FIRST

#: Python state needs the provider that holds it on disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAULTS = "chain string, seq bigint, fault string"


def said_hash(prev: str, seq: int, said: str) -> str:
    """The hash of an entry: of the one before, its number and what it says."""
    return hashlib.sha256(f"{prev}|{seq}|{said}".encode()).hexdigest()


class Links(StatefulProcessor):
    """Checks each entry against the last of its chain: gap, prev, hash, or repeated for a number that came before.

    The entries of a micro-batch are taken in the order of their numbers. One that is wrong is told, and the chain goes on from it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, before = self.last.get() if self.last.exists() else (0, FIRST)
        out = []
        for r in pd.concat(list(rows)).sort_values(["seq", "hash"]).itertuples():
            if r.seq <= seq:
                out.append((key[0], r.seq, "repeated"))
                continue
            fault = "gap" if r.seq != seq + 1 else "prev" if r.prev != before else "hash" if r.hash != said_hash(r.prev, r.seq, r.said) else None
            if fault:
                out.append((key[0], r.seq, fault))
            seq, before = int(r.seq), r.hash
        self.last.update((seq, before))
        yield pd.DataFrame(out, columns=["chain", "seq", "fault"])

    def close(self) -> None:
        pass


def faults(entries: DataFrame) -> DataFrame:
    """chain, seq, fault of a stream of entries (chain, seq, said, prev, hash)."""
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return entries.select("chain", "seq", "said", "prev", "hash").groupBy("chain").transformWithStateInPandas(Links(), FAULTS, "append", "none")


def watch(spark: SparkSession, entries: str, schema: str, out: str, checkpoint: str, files: int = 1) -> StreamingQuery:
    """Checks the entries in a folder of Parquet files that grows; goes on from its checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(entries)
    return faults(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
