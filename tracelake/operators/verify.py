"""Verification of a case: what is stored against what the rows themselves give, as joins of two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .chains import chain_minimum


def compared(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys and state of each key of either side: equal, differs, not-stored or not-found; with the names of the values that differ."""
    one = stored.select(*keys, *[F.col(v).alias(f"_s_{v}") for v in values], F.lit(True).alias("_s"))
    two = recomputed.select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_r"))
    both = one.join(two, list(keys), "full")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"_s_{v}").eqNullSafe(F.col(f"_r_{v}")), v) for v in values]))
    state = F.when(F.col("_s").isNull(), "not-stored").when(F.col("_r").isNull(), "not-found").when(F.size(wrong) == 0, "equal").otherwise("differs")
    return both.select(*keys, state.alias("state"), F.when(state == "differs", F.array_join(wrong, ",")).otherwise("").alias("wrong"))


def batches_of(recs: DataFrame, run: str, batch_rows: int) -> DataFrame:
    """run, batch_no, first_id, last_id, n of the stored records."""
    no = F.floor((F.col("id") - 1) / batch_rows)
    return recs.groupBy(run, no.alias("batch_no")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


def run_totals(batches: DataFrame, run: str) -> DataFrame:
    """run, batches, records, first_id, last_id: what a run's row must say, from its batches."""
    return batches.groupBy(run).agg(F.count("*").alias("batches"), F.sum("n").alias("records"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def tallies(log: DataFrame, run: str, kind: str) -> DataFrame:
    """run, kind, n of logged warnings and rejections."""
    return log.groupBy(run, kind).agg(F.count("*").alias("n"))


def next_ids(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """name, n, next_id of tables (table, id column): one row each; an empty table starts at 1."""
    out = None
    for name, (table, key) in tables.items():
        row = table.agg(F.count("*").alias("n"), (F.coalesce(F.max(key), F.lit(0)) + 1).cast("bigint").alias("next_id")).select(F.lit(name).alias("name"), "n", "next_id")
        out = row if out is None else out.union(row)
    return out


def recovered_rules(recs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """id and broken rule of records (id, artifact_id, recovered, confidence) over artifacts (artifact_id, parent_id, recovered, confidence).

    live-on-recovered: a record said to be live on a recovered artifact; above-chain: a recovered record's confidence is above
    the least of its artifact's chain; no-confidence: a recovered record without one; orphan: no such artifact.
    """
    least = chain_minimum(artifacts, "artifact_id", "parent_id", "confidence")
    of = artifacts.select("artifact_id", F.col("recovered").alias("_recovered")).join(least, "artifact_id")
    out = recs.join(of, "artifact_id", "left")
    rule = (
        F.when(F.col("_recovered").isNull(), "orphan").when(F.col("_recovered") & ~F.col("recovered"), "live-on-recovered")
        .when(F.col("recovered") & F.col("confidence").isNull(), "no-confidence").when(F.col("recovered") & (F.col("confidence") > F.col("least")), "above-chain")
    )
    return out.select("id", rule.alias("rule")).where("rule IS NOT NULL")


def rehashed(manifest: DataFrame, files: DataFrame, path: str, content: str) -> DataFrame:
    """path and state of a manifest (path, sha256, size) against files: bound, differs, missing, unmanifested or duplicate."""
    data = F.col(content).cast("binary")
    held = files.groupBy(path).agg(F.count("*").alias("_n"), F.min(F.sha2(data, 256)).alias("_hash"), F.min(F.octet_length(data)).alias("_size"))
    named = manifest.groupBy(path).agg(F.count("*").alias("_m"), F.min("sha256").alias("sha256"), F.min("size").alias("size"))
    state = (
        F.when((F.col("_m") > 1) | (F.col("_n") > 1), "duplicate").when(F.col("_n").isNull(), "missing").when(F.col("_m").isNull(), "unmanifested")
        .when((F.col("sha256") == F.col("_hash")) & (F.col("size") == F.col("_size")), "bound").otherwise("differs")
    )
    return named.join(held, path, "full").select(path, state.alias("state"))


def schema_differences(stored: StructType, expected: StructType) -> list[tuple[str, str]]:
    """(column, state) of columns that differ: missing, extra, type or nullable."""
    have, want = {f.name: f for f in stored.fields}, {f.name: f for f in expected.fields}
    out = [(c, "missing") for c in want if c not in have] + [(c, "extra") for c in have if c not in want]
    for c in want:
        if c in have and have[c].dataType != want[c].dataType:
            out.append((c, "type"))
        elif c in have and have[c].nullable and not want[c].nullable:
            out.append((c, "nullable"))
    return sorted(out)


def repeated(rows: DataFrame, keys: Sequence[str], age: str, gone: Column) -> DataFrame:
    """Keys that are held under two ages or more and never marked as gone, with how many ages."""
    return rows.groupBy(*keys).agg(F.count_distinct(age).alias("ages"), F.count_if(gone).alias("_gone")).where("ages >= 2 AND _gone = 0").drop("_gone")


def allocation(ranges: DataFrame, free: DataFrame, key: str) -> DataFrame:
    """key, free, allocated of the bytes of ranges (key, start, stop, not overlapping) over a map of free runs (key, start, stop, merged); unknown where a key has no map.

    Both are laid end to end: the free bytes before a point are a running sum over one sort of all edges.
    """
    from pyspark.sql import Window

    size = F.col("stop") - F.col("start")
    edges = free.select(key, F.col("start").alias("at"), F.lit(1).alias("open"), F.lit(False).alias("asked"), F.lit(0).alias("side")).union(
        free.select(key, F.col("stop"), F.lit(-1), F.lit(False), F.lit(0))
    ).union(ranges.select(key, F.col("start"), F.lit(0), F.lit(True), F.lit(-1))).union(ranges.select(key, F.col("stop"), F.lit(0), F.lit(True), F.lit(1)))
    order = Window.partitionBy(key).orderBy("at")
    run = edges.groupBy(key, "at").agg(F.sum("open").alias("open"), F.sum("side").alias("side"))
    run = run.withColumn("_depth", F.sum("open").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_before", F.lag("at").over(order))
    run = run.withColumn("_free", F.sum(F.when(F.col("_depth") > 0, F.col("at") - F.col("_before")).otherwise(0)).over(order))
    inside = run.groupBy(key).agg(F.sum(F.col("_free") * F.col("side")).alias("_inside"))
    known = free.select(key).distinct().withColumn("_known", F.lit(True))
    total = ranges.groupBy(key).agg(F.sum(size).alias("bytes")).join(inside, key, "left").join(known, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return total.select(key, zero(F.when(F.col("_known"), F.col("_inside"))).alias("free"), zero(F.when(F.col("_known"), F.col("bytes") - F.col("_inside"))).alias("allocated"), zero(F.when(F.col("_known").isNull(), F.col("bytes"))).alias("unknown"))
