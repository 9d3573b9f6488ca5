"""Chains of derivation: each node names the node that it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.sources.staging import staged


def walk(nodes: DataFrame, key: str, parent: str, cap: int = 64, claimed: str | None = None, digest: str | None = None) -> DataFrame:
    """key, last, depth, state of each node's way up by its parents.

    state: ok (last is a root, which names no parent), missing (last names a node that isn't there), differs (the digest of the
    node that last names isn't the one it claims), depth (a root, but beyond cap steps) or cycle. Pointers are doubled, so that n steps
    take log2(n) rounds; each round is a written table. Ways that haven't ended after as many steps as there are nodes go
    round in a cycle; last and depth are null for these. Keys are unique.
    """
    up = nodes.select(F.col(key).alias("k"), F.col(parent).alias("p"), (F.col(claimed) if claimed else F.lit(None).cast("string")).alias("c"))
    over = nodes.select(F.col(key).alias("_k"), (F.col(digest) if digest else F.lit(None).cast("string")).alias("_d"))
    joined = up.join(over, F.col("p") == F.col("_k"), "left")
    end = F.when(F.col("p").isNull(), "ok").when(F.col("_k").isNull(), "missing").when(~F.col("c").eqNullSafe(F.col("_d")), "differs")
    now = staged(joined.select("k", F.when(end.isNotNull(), F.col("k")).otherwise(F.col("p")).alias("at"), F.when(end.isNull(), 1).otherwise(0).cast("bigint").alias("depth"), end.alias("state")), "chain")
    steps, n = 1, now.count()
    while steps < n and not now.where("state IS NULL").isEmpty():
        far = now.select(F.col("k").alias("_k"), F.col("at").alias("_at"), F.col("depth").alias("_d"), F.col("state").alias("_s"))
        going = now.where("state IS NULL").join(far, F.col("at") == F.col("_k"))
        now = staged(now.where("state IS NOT NULL").union(going.select("k", F.col("_at"), F.col("depth") + F.col("_d"), F.col("_s"))), "chain")
        steps *= 2
    ended = F.col("state").isNotNull()
    state = F.when(~ended, "cycle").when((F.col("state") == "ok") & (F.col("depth") > cap), "depth").otherwise(F.col("state"))
    return now.select(F.col("k").alias(key), F.when(ended, F.col("at")).alias("last"), F.when(ended, F.col("depth")).alias("depth"), state.alias("state"))


def chain_minimum(nodes: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """key and the least value on each node's whole way up, itself included; a way into a cycle covers all of the cycle.

    Pointers are doubled until every way has ended, or has had as many steps as there are nodes.
    """
    now = staged(nodes.select(F.col(key).alias("k"), F.col(parent).alias("at"), F.col(value).alias("v")), "chain")
    steps, n = 1, now.count()
    while steps < n and not now.where("at IS NOT NULL").isEmpty():
        far = now.select(F.col("k").alias("_k"), F.col("at").alias("_at"), F.col("v").alias("_v"))
        now = staged(now.join(far, F.col("at") == F.col("_k"), "left").select("k", F.col("_at").alias("at"), F.least("v", "_v").alias("v")), "chain")
        steps *= 2
    return now.select(F.col("k").alias(key), F.col("v").alias("least"))
