"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, stage_table


def connected_components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, label (the smallest node that it reaches) of every node of edges (a, b); node ids are integers.

    In a large star every node hands its larger neighbours to its smallest one; in a small star its smaller neighbours and
    itself. Both keep the components, and after about as many rounds as the logarithm of the nodes only stars are left.
    Neighbours are never gathered: minima are pre-aggregated and joined back.
    """
    now = stage_table(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or tuple(state) == before:
            break
        before = tuple(state)
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, both["u"] == least["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(first, large["u"] == first["k"]).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        last, now = now, stage_table(small, name)
        drop_tables(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
