"""What to run over a set of artifacts: bundles of files, their state against earlier runs, and who claims which table.

A bundle is a primary file, found by the name that a parser reads, and its companions: files of the same acquisition whose path is
the primary's with a suffix. Its digest is over roles and contents of all members, so a bundle of which a companion has come, gone
or changed isn't the one that was parsed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles of companions: suffix of the path.
COMPANIONS = {"wal": "-wal", "journal": "-journal"}


def bundles(files: DataFrame, parser: Column, companions: Mapping[str, str] = COMPANIONS) -> DataFrame:
    """parser, acquisition, path, artifact, members (role, artifact, sha256), ambiguous (roles), digest, from files (artifact, acquisition, path, sha256, encrypted).

    parser: the parser that reads a file of that path as its primary; null for none. Of several files for one role none is taken.
    """
    primary = files.withColumn("parser", parser).where("parser IS NOT NULL")
    wanted = primary.select("artifact", "acquisition", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.concat("path", F.lit(s)).alias("path")) for r, s in companions.items()])).alias("w")).select(F.col("artifact").alias("_primary"), "acquisition", F.col("w.role").alias("role"), F.col("w.path").alias("path"))
    one = files.groupBy("acquisition", "path").agg(F.count("*").alias("_n"), F.min(F.struct("artifact", "sha256", "encrypted")).alias("_file"))
    found = wanted.join(one, ["acquisition", "path"])
    member = F.when(F.col("_n") == 1, F.struct("role", F.col("_file.artifact").alias("artifact"), F.col("_file.sha256").alias("sha256"), F.col("_file.encrypted").alias("encrypted")))
    # At most one entry for each role.
    held = found.groupBy("_primary").agg(F.collect_list(member).alias("_others"), F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.col("role")))).alias("_ambiguous"))
    out = primary.join(held, F.col("artifact") == F.col("_primary"), "left")
    own = F.struct(F.lit("primary").alias("role"), "artifact", "sha256", "encrypted")
    members = F.array_sort(F.concat(F.array(own), F.coalesce("_others", F.array().cast("array<struct<role:string,artifact:bigint,sha256:string,encrypted:boolean>>"))))
    said = F.array_join(F.transform(members, lambda m: F.concat_ws("=", m["role"], m["sha256"])), "\n")
    return out.select("parser", "acquisition", "path", "artifact", members.alias("members"), F.coalesce("_ambiguous", F.array().cast("array<string>")).alias("ambiguous"), F.sha2(said, 256).alias("digest"))


def jobs(found: DataFrame, runs: DataFrame, identity: Mapping[str, str]) -> DataFrame:
    """parser, artifact, path, digest, status, reason of each bundle, against runs (parser, identity, artifact, digest of the bundle then).

    unparsed: an encrypted member, or a role that several files could fill; new: no member was covered by a run of this very
    parser; already-parsed: all were, as this bundle; stale-bundle: only some were, or the bundle has another digest now.
    identity: what a parser is, by name; runs of another identity cover nothing.
    """
    names = F.create_map(*[F.lit(x) for p in identity.items() for x in p])
    done = runs.where(F.col("identity") == F.try_element_at(names, F.col("parser"))).groupBy("parser", "artifact").agg(F.max_by("digest", "run").alias("_last"))
    each = found.select("parser", F.col("artifact").alias("_primary"), "digest", F.explode("members").alias("m")).select("parser", "_primary", "digest", "m.*")
    covered = each.join(done, ["parser", "artifact"], "left").groupBy("parser", "_primary").agg(
        F.count("*").alias("_all"), F.count("_last").alias("_covered"), F.bool_or(F.col("_last") != F.col("digest")).alias("_changed"), F.bool_or("encrypted").alias("_encrypted"),
        F.array_sort(F.collect_list(F.when(F.col("_last").isNull(), F.col("artifact")))).alias("_open"),
    )
    out = found.join(covered.withColumnRenamed("_primary", "artifact"), ["parser", "artifact"])
    status = (
        F.when(F.coalesce("_encrypted", F.lit(False)) | (F.size("ambiguous") > 0), "unparsed").when(F.col("_covered") == 0, "new")
        .when((F.col("_covered") == F.col("_all")) & ~F.coalesce("_changed", F.lit(False)), "already-parsed").otherwise("stale-bundle")
    )
    reason = (
        F.when(F.size("ambiguous") > 0, F.concat(F.lit("ambiguous companion: "), F.array_join("ambiguous", ", "))).when(F.coalesce("_encrypted", F.lit(False)), "encrypted")
        .when(status == "stale-bundle", F.when(F.size("_open") > 0, F.concat(F.lit("not covered by an earlier run: "), F.array_join(F.col("_open").cast("array<string>"), ", "))).otherwise("another bundle than was parsed"))
    )
    return out.select("parser", "artifact", "path", "digest", status.alias("status"), reason.alias("reason"))


def claims(tables: DataFrame, claimed: DataFrame) -> DataFrame:
    """artifact, name, state, parsers of every table (artifact, platform, name) against claims (parser, platform, name).

    claimed by one parser, ambiguous by several, or unclaimed; names compare without case, as the database does.
    """
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = claimed.groupBy("platform", low("name").alias("_name")).agg(F.array_join(F.array_sort(F.collect_set("parser")), ",").alias("parsers"), F.count_distinct("parser").alias("_k"))
    out = tables.withColumn("_low", low("name")).join(by.withColumnRenamed("platform", "_platform"), (F.col("platform") == F.col("_platform")) & (F.col("_low") == F.col("_name")), "left")
    return out.select("artifact", "name", F.when(F.col("_k").isNull(), "unclaimed").when(F.col("_k") > 1, "ambiguous").otherwise("claimed").alias("state"), "parsers")


def unclaimed(files: DataFrame, parser: Column, looks: Column) -> DataFrame:
    """artifact, path of files that look like databases and that no parser reads, nor any as a companion."""
    base = F.regexp_replace("path", "(" + "|".join(s.replace("-", "[-]") for s in COMPANIONS.values()) + ")$", "")
    named = files.withColumn("_parser", parser)
    owners = named.where("_parser IS NOT NULL").select("acquisition", F.col("path").alias("_base")).distinct()
    rest = named.where(F.col("_parser").isNull() & looks).withColumn("_base", base)
    return rest.join(owners, ["acquisition", "_base"], "left_anti").select("artifact", "path")
