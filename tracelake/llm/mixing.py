"""Mixing sources to target weights by Sainte-Laguë apportionment, from DataFrame functions only.

Tokens are cut into equal blocks. Seats (blocks) go to sources by highest quotients weight / (2k - 1), and within a
source to its shards in the same way, which gives integer quotas for each shard. Inside a shard the documents lie in a
seeded order on one token axis; its blocks are selected systematically from a seeded start: block k is taken
floor((k+1)q/n + u) - floor(kq/n + u) times for a quota of q over n blocks. A document takes the tokens that its range
shares with the selected blocks, so no block is exploded and no source is sorted as a whole.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated rows are
separate documents in a stable order; an empty table gives an empty result; other columns are not read. A source's number
of shards follows its size, so a source that holds a third of all rows is many small groups; all sources have about
``max_shards`` at most, which bounds what ranks the quotients of one source. Sources are ranked and summed by ranges, as
there may be as many as hosts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, stage_table, sums_before

WEIGHTS = (5, 2, 1)
SEED = 17


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a keyed digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, source_size -> with weight and target: shares of the total, no more than max_repeats times a source's size.

    Sources in order of cap / weight are full up to a level; that level is the first at which a source isn't full.
    """
    by_name = {"_null": F.col("source").isNull(), "_name": F.col("source")}
    at = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int") + 1
    base = sums_before(sizes, by_name, {"_rank": F.lit(1).cast("long")}, "mix-names")
    base = base.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at)).withColumn("_cap", (F.col("source_size") * max_repeats).cast("double")).drop("_rank")
    fill = {"_fill": F.col("_cap") / F.col("_w"), **by_name}
    base = sums_before(base, fill, {"_full": F.col("_cap"), "_used": F.col("_w")}, "mix-fill")
    total = base.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("weight")).first()
    base = base.withColumn("_level", (F.lit(total["size"]) - F.col("_full")) / (F.lit(total["weight"]) - F.col("_used")))
    # The level of the first source, in the order of filling, that isn't full.
    open_ = base.where(F.col("_cap") > F.col("_w") * F.col("_level")).agg(F.min(F.struct(*[c.alias(n) for n, c in fill.items()], "_level")).alias("first")).first()["first"]
    return base.withColumn("target", F.least(F.col("_cap"), F.col("_w") * F.lit(open_["_level"])) if open_ else F.col("_cap")).select(*sizes.columns, "target")


def apportion(parties: DataFrame, name: list[str], weight: str, seats: Column, within: list[str], out: str) -> DataFrame:
    """Sainte-Laguë: adds the seats of each party, the highest quotients weight / (2k - 1) winning.

    Rounding weight * seats / total gives each party all but its last few seats; only the quotients near that edge are
    laid out and ranked.
    """
    if within:
        group = Window.partitionBy(*within)
        base = parties.withColumn("_seats", seats).withColumns({"_all": F.sum(weight).over(group), "_n": F.count("*").over(group)})
    else:
        total = parties.agg(F.sum(weight).alias("all"), F.count("*").alias("n")).first()
        base = parties.withColumn("_seats", seats).withColumns({"_all": F.lit(total["all"] or 0.0), "_n": F.lit(total["n"])})
    base = base.withColumn("_share", F.when(F.col("_all") > 0, F.col(weight) / F.col("_all")).otherwise(F.lit(0.0)))
    base = base.withColumn("_near", (F.lit(2) + F.ceil(F.col("_n") * F.col("_share"))).cast("long"))
    base = base.withColumn("_mid", F.floor(F.col("_seats") * F.col("_share") + 0.5)).withColumn("_sure", F.greatest(F.col("_mid") - F.col("_near"), F.lit(0)))
    if within:
        base = base.withColumn("_left", F.col("_seats") - F.sum("_sure").over(group))
    else:
        base = base.withColumn("_left", F.col("_seats") - F.lit(base.agg(F.sum("_sure")).first()[0] or 0))
    edge = base.select(*name, F.col(weight), "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_mid") + F.col("_near"))).alias("_k")).where(F.col(weight) > 0)
    names = [x for c in name for x in (F.col(c).isNull(), F.col(c))]
    quotient = F.col(weight) / (2 * F.col("_k") - 1)
    if within:
        edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(quotient.desc(), *names)))
    else:
        order = {"_lower": -quotient} | {f"_by{i}": x for i, x in enumerate(names)}
        edge = sums_before(edge, order, {"_rank": F.lit(1).cast("long")}, "mix-edge").withColumn("_rank", F.col("_rank") + 1)
    won = edge.where("_rank <= _left").groupBy(*name).agg(F.count("*").alias("_won")).withColumnsRenamed({c: f"_n_{c}" for c in name})
    on = None
    for c in name:
        on = base[c].eqNullSafe(won[f"_n_{c}"]) if on is None else on & base[c].eqNullSafe(won[f"_n_{c}"])
    return base.join(won, on, "left").withColumn(out, F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).select(*parties.columns, out)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, block_tokens: int = 64, shard_tokens: int = 100_000, max_shards: int = 200_000, seed: int = SEED, max_repeats: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each input row, and the columns to keep."""
    sized = stage_table(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, max_repeats)
    # A source's blocks number round(total / block); the block is smaller where the smallest target is small.
    sources = stage_table(sources, "mix-targets")
    total = sources.agg(F.sum("target").alias("targets"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least"), F.sum("source_size").alias("words")).first()
    block = max(1, min(block_tokens, math.floor(total["least"] / 100))) if total["least"] else 1
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / float(max(shard_tokens, (total["words"] or 0) / max_shards))))
    sources = sources.withColumns({"_block": F.lit(block).cast("long"), "_shards": shards.cast("long")})
    sources = apportion(sources, ["source"], "target", F.lit(math.floor((total["targets"] or 0.0) / block + 0.5)).cast("long"), [], "_quota")
    sources = stage_table(sources.withColumn("_quota", F.least(F.col("_quota"), max_repeats * F.ceil(F.col("source_size") / F.col("_block")))), "mix-sources")
    of = sources.withColumnRenamed("source", "_source")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    placed = sized.join(of, sized["source"].eqNullSafe(of["_source"]), "left").drop("_source").withColumn("_order", order)
    placed = placed.withColumn("_shard", F.pmod(F.conv(F.substring("_order", 25, 8), 16, 10).cast("long"), F.col("_shards")))
    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_size"), F.first("_quota").alias("_q"), F.first("_block").alias("_b"))
    shards = apportion(shards, ["source", "_shard"], "_size", F.col("_q"), ["source"], "_seats")
    n_blocks = F.ceil(F.col("_size") / F.col("_b"))
    shards = shards.select(F.col("source").alias("_source"), F.col("_shard").alias("_s"), n_blocks.alias("_n"), F.least(F.col("_seats"), max_repeats * n_blocks).alias("_seats"))
    run = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(run))
    laid = laid.join(shards, laid["source"].eqNullSafe(shards["_source"]) & (laid["_shard"] == shards["_s"]), "left")
    laid = laid.withColumn("_u", F.floor(_unit(F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("_shard").cast("string")) * F.col("_n")))

    def upto(k: Column) -> Column:  # copies of the blocks before k, in whole numbers
        return F.floor((k * F.col("_seats") + F.col("_u")) / F.greatest(F.col("_n"), F.lit(1))).cast("long")

    def taken(x: Column) -> Column:
        k = F.floor(x / F.col("_block"))
        return upto(k) * F.col("_block") + F.pmod(x, F.col("_block")) * (upto(k + 1) - upto(k))

    out = F.when(F.col("size") > 0, taken(F.col("_end")) - taken(F.col("_end") - F.col("size"))).otherwise(F.lit(0))
    return laid.select("doc_id", "source", "size", "source_size", "target", out.cast("long").alias("taken"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])
