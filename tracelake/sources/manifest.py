"""The manifest of a case: one JSON object for each artifact; and the artifacts it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a manifest line: name, type, whether it must be there.
FIELDS = (("id", "string", True), ("path", "string", True), ("sha256", "string", True), ("size", "bigint", True), ("kind", "string", True), ("parent", "string", False), ("snapshot", "string", False))
LIVE, RECOVERED = ("file", "backup"), ("recover", "carve")


def parsed(lines: DataFrame, line: str) -> DataFrame:
    """The fields of every line and its state: ok, not-json, repeated-key, unknown-key, missing (a field that must be there) or bad-value."""
    text, names = F.col(line), [n for n, _, _ in FIELDS]
    v, keys = F.try_parse_json(text), F.json_object_keys(text)
    typed = {n: F.try_variant_get(v, f"$.{n}", t) for n, t, _ in FIELDS}
    as_text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    missing, bad = F.lit(False), F.lit(False)
    for n, _, needed in FIELDS:
        missing = missing | as_text(n).isNull() if needed else missing
        bad = bad | (as_text(n).isNotNull() & typed[n].isNull())
    bad = bad | ~F.coalesce(typed["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(True)) | (F.coalesce(typed["size"], F.lit(0)) < 0)
    # A key that is there twice is no JSON to the parser of variants, but has keys.
    state = (
        F.when(v.isNull() & (F.size(keys) > F.size(F.array_distinct(keys))), "repeated-key").when(v.isNull() | keys.isNull(), "not-json")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0, "unknown-key").when(missing, "missing").when(bad, "bad-value").otherwise("ok")
    )
    return lines.select(*lines.columns, state.alias("state"), *[c.alias(n) for n, c in typed.items()])


def eligible(kind: Column, snapshot: Column, from_recovered: Column, snapshots: bool = False, recovered: bool = False) -> Column:
    """Why an artifact is no input of parsers; null if it is: files, backups and extracts are, snapshots and what is recovered if asked for."""
    return (
        F.when(kind.isNull() | (kind == ""), "no kind").when(kind.isin(*LIVE), None)
        .when((kind == "extract") & snapshot.isNotNull() & F.lit(not snapshots), "snapshot").when((kind == "extract") & from_recovered & F.lit(not recovered), "recovered").when(kind == "extract", None)
        .when(kind.isin(*RECOVERED), None if recovered else "recovered").otherwise(F.concat(F.lit("kind "), kind))
    )


def opened(ids: DataFrame, manifest: DataFrame, files: DataFrame, content: str) -> DataFrame:
    """id, state and content of artifacts (id) by the manifest (id, path, sha256) and files (path, content): ok, unknown, ambiguous, absent or altered; content only where ok."""
    one = manifest.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"), F.min("path").alias("_path"), F.min("sha256").alias("_hash"))
    out = ids.join(one, F.col("id") == F.col("_id"), "left").join(files.select(F.col("path").alias("_file"), F.col(content).alias("_data")), F.col("_path") == F.col("_file"), "left")
    same = F.sha2(F.col("_data").cast("binary"), 256) == F.col("_hash")
    state = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").when(F.col("_file").isNull(), "absent").when(same, "ok").otherwise("altered")
    return out.select("id", state.alias("state"), F.when(state == "ok", F.col("_data")).alias("content"))


def backup_files(rows: DataFrame, held: DataFrame) -> DataFrame:
    """domain, path, file_id, state of a backup's file table (fileID, domain, relativePath, flags) against held files (name).

    A file is kept under the SHA-1 of its domain and path; renamed: its row says another name. Flags: 1 file, 2 folder, 4 link.
    """
    want = F.sha1(F.concat_ws("-", "domain", "relativePath"))
    here = held.groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("_n"))
    out = rows.join(here, F.col("fileID") == F.col("_name"), "left")
    state = F.when(F.col("flags") != 1, "no-file").when(F.col("fileID") != want, "renamed").when(F.col("_n").isNull(), "missing").otherwise("found")
    return out.select("domain", F.col("relativePath").alias("path"), F.col("fileID").alias("file_id"), state.alias("state"))


def runs_of(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, start, stop of lists of runs as JSON ([{"offset":0,"length":1}]); negative or missing numbers are no runs."""
    listed = F.from_json(F.col(line), "array<struct<offset:bigint,length:bigint>>")
    return lines.select(key, F.explode(listed).alias("_r")).where("_r.offset >= 0 AND _r.length > 0").select(key, F.col("_r.offset").alias("start"), (F.col("_r.offset") + F.col("_r.length")).alias("stop"))
