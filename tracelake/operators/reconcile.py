"""Reconciliation of what several sources say about the same things, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(named: DataFrame, held: DataFrame, key: str, digest: str) -> DataFrame:
    """key and state: bound, differs, missing (named only), unnamed (held only) or duplicate (named or held repeatedly)."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"_n{n}"), F.min(digest).alias(f"_d{n}"))
    state = (
        F.when(F.greatest(F.coalesce("_n1", F.lit(0)), F.coalesce("_n2", F.lit(0))) > 1, "duplicate")
        .when(F.col("_n2").isNull(), "missing").when(F.col("_n1").isNull(), "unnamed").when(F.col("_d1").eqNullSafe(F.col("_d2")), "bound").otherwise("differs")
    )
    return side(named, 1).join(side(held, 2), key, "full").select(key, state.alias("state"))


def roles(files: DataFrame, group: str, path: str, main: Column, companions: dict[str, str]) -> DataFrame:
    """Main files with the state of each companion role (name: suffix): ok, missing or ambiguous, within their group."""
    out = files.where(main).select(group, path)
    for role, suffix in companions.items():
        side = files.where(F.endswith(F.col(path), F.lit(suffix))).select(F.col(group).alias("_g"), F.expr(f"substr({path}, 1, length({path}) - {len(suffix)})").alias("_p"))
        side = side.groupBy("_g", "_p").agg(F.count("*").alias("_n"))
        out = out.join(side, (F.col(group) == F.col("_g")) & (F.col(path) == F.col("_p")), "left")
        out = out.withColumn(role, F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("ok")).drop("_g", "_p", "_n")
    return out


def last_state(log: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The state after the last entry of each key: one aggregate, nothing sorted."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("entries"))


def jobs(log: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """Each start with how it went on: finished (an end follows), restarted (a start follows) or open; and ends without a start."""
    w = Window.partitionBy(key).orderBy(*order)
    log = log.withColumns({"_next": F.lead(kind).over(w), "_before": F.lag(kind).over(w)})
    state = (
        F.when(F.col(kind) == "start", F.when(F.col("_next") == "end", "finished").when(F.col("_next") == "start", "restarted").otherwise("open"))
        .when((F.col(kind) == "end") & ~F.col("_before").eqNullSafe(F.lit("start")), "unstarted")
    )
    return log.withColumn("state", state).where("state IS NOT NULL").drop("_next", "_before")


def outside(ranges: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Ranges (key, offset, length) that don't lie in their artifact (key, size); nothing is added, so nothing overflows."""
    bad = F.col("size").isNull() | (F.col("offset") < 0) | (F.col("length") < 0) | (F.col("offset") > F.col("size")) | (F.col("length") > F.col("size") - F.col("offset"))
    return ranges.join(sizes, key, "left").where(bad).select(*ranges.columns)


def audit_chain(log: DataFrame, key: str, seq: str, previous: str, digest: str, fields: list[str]) -> DataFrame:
    """Entries of a log that break its chain, and how: gap (a number is left out), repeated (a number twice), unlinked (the previous digest
    isn't that of the entry before; empty for the first) or altered (the digest isn't that of the fields)."""
    w = Window.partitionBy(key).orderBy(seq)
    log = log.withColumns({"_seq": F.lag(seq).over(w), "_hash": F.lag(digest, 1, "").over(w)})
    state = (
        F.when(F.col(seq) == F.col("_seq"), "repeated").when(F.col(seq) != F.coalesce("_seq", F.lit(0)) + 1, "gap").when(~F.col(previous).eqNullSafe(F.col("_hash")), "unlinked")
        .when(~F.col(digest).eqNullSafe(F.sha2(F.concat_ws("|", *fields), 256)), "altered")
    )
    return log.withColumn("state", state).where("state IS NOT NULL").drop("_seq", "_hash")


def orphans(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key no known row has; a null key is an orphan too."""
    return rows.join(known.select(F.col(known_key).alias("_known")).distinct(), F.col(key) == F.col("_known"), "left_anti")


def located(refs: DataFrame, files: DataFrame, path: str, source: str) -> DataFrame:
    """refs with state and files of the files that they name: found, ambiguous (several in the same source), other-source (elsewhere
    only) or unresolved. Files are counted by path and source first, so no row of refs is multiplied."""
    by = files.groupBy(F.col(path).alias("_path"), F.col(source).alias("_source")).agg(F.count("*").alias("_k"))
    anywhere = by.groupBy(F.col("_path").alias("_any")).agg(F.sum("_k").alias("files"))
    out = refs.join(anywhere, F.col(path) == F.col("_any"), "left").join(by, (F.col(path) == F.col("_path")) & (F.col(source) == F.col("_source")), "left")
    state = F.when(F.col("_k") == 1, "found").when(F.col("_k") > 1, "ambiguous").when(F.col("files").isNotNull(), "other-source").otherwise("unresolved")
    return out.select(*refs.columns, state.alias("state"), F.coalesce("files", F.lit(0)).alias("files"))


def owners(files: DataFrame, group: str, path: str, primary: Column, companions: dict[str, str]) -> DataFrame:
    """group, path, role, owner, state of every companion: the primary whose path it extends.

    state: ok, orphan (no such primary), ambiguous (several primaries of that path), or shared (the primary has several files for that
    role, so none is its companion).
    """
    base, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, suffix in companions.items():
        is_it = F.endswith(F.col(path), F.lit(suffix)) & ~primary
        base = F.when(is_it, F.substring(path, 1, F.length(path) - len(suffix))).otherwise(base)
        role = F.when(is_it, name).otherwise(role)
    mine = files.select(F.col(group).alias("_g"), F.col(path).alias("_p"), base.alias("_base"), role.alias("_role")).where("_role IS NOT NULL")
    heads = files.where(primary).groupBy(F.col(group).alias("_hg"), F.col(path).alias("_hp")).agg(F.count("*").alias("_n"))
    same = mine.groupBy("_g", "_base", "_role").agg(F.count("*").alias("_k"))
    out = mine.join(heads, (F.col("_g") == F.col("_hg")) & (F.col("_base") == F.col("_hp")), "left").join(same, ["_g", "_base", "_role"])
    state = F.when(F.col("_n").isNull(), "orphan").when(F.col("_n") > 1, "ambiguous").when(F.col("_k") > 1, "shared").otherwise("ok")
    return out.select(F.col("_g").alias(group), F.col("_p").alias(path), F.col("_role").alias("role"), F.when(F.col("_n") == 1, F.col("_base")).alias("owner"), state.alias("state"))
