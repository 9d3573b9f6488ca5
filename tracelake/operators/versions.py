"""Versions of pages in a log beside a file, and the views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def views(base: DataFrame, frames: DataFrame, key: str = "file") -> DataFrame:
    """key, page, as_found, live, versions: the content of every page of base (key, page, content) under frames (key, page, seq, content, commits).

    A frame counts for the live view if some frame at or after it in its file commits; as found, every frame does. The last
    one of a page wins. Frames after the last commit are of a transaction that was left open or rolled back.
    """
    last = frames.groupBy(F.col(key).alias("_f")).agg(F.max(F.when(F.col("commits"), F.col("seq"))).alias("_last"))
    marked = frames.join(last, F.col(key) == F.col("_f"), "left")
    committed = F.coalesce(F.col("seq") <= F.col("_last"), F.lit(False))
    newest = marked.groupBy(key, "page").agg(F.max_by("content", "seq").alias("_any"), F.max_by(F.when(committed, F.col("content")), F.when(committed, F.col("seq"))).alias("_live"), F.count("*").alias("versions"))
    out = base.select(key, "page", F.col("content").alias("_base")).join(newest, [key, "page"], "full")
    return out.select(key, "page", F.coalesce("_any", "_base").alias("as_found"), F.coalesce("_live", "_base").alias("live"), F.coalesce("versions", F.lit(0)).alias("versions"))


def relations(live: DataFrame, recovered: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and relation of recovered rows to live ones: equal, differs, unknown (a value can't be told), recovered-only or live-only.

    A null on the recovered side is a value that couldn't be read.
    """
    one = live.select(*keys, *[F.col(v).alias(f"_l_{v}") for v in values], F.lit(True).alias("_l"))
    two = recovered.select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_r"))
    differs, unknown = F.lit(False), F.lit(False)
    for v in values:
        differs = differs | (F.col(f"_r_{v}").isNotNull() & ~F.col(f"_l_{v}").eqNullSafe(F.col(f"_r_{v}")))
        unknown = unknown | (F.col(f"_r_{v}").isNull() & F.col(f"_l_{v}").isNotNull())
    relation = F.when(F.col("_l").isNull(), "recovered-only").when(F.col("_r").isNull(), "live-only").when(differs, "differs").when(unknown, "unknown").otherwise("equal")
    return one.join(two, keys, "full").select(*keys, relation.alias("relation"))
