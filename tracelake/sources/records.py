"""The record store over the driver's tables: one typed, append-only model for all artifact families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (parser_id, name, version)
PARSERS = [(1, "app.events", "1.0"), (2, "app.events", "1.1"), (3, "app.chat", "1.0"), (4, "app.store", "2.0")]
#: (end_seq, ingest_id, parser_id, outcome)
RUNS = [(10, "r0", 1, "complete"), (20, "r1", 2, "complete"), (30, "r2", 3, "incomplete"), (40, "r3", 4, "complete"), (50, "r4", 3, "complete")]
#: Coverage of a run that stored no rows.
EXTRA_COVERAGE = [("r4", "c0"), ("r4", "c1")]

COLUMNS = ["id", "type", "artifact_id", "source_path", "ts", "deleted", "recovered", "confidence", "ingest_id", "summary", "body"]


def _micros(column: str) -> str:
    return f"unix_micros(cast({column} AS timestamp))"


PARTS = {
    "events": [
        "event_id + 1 AS id",
        "CASE event_type WHEN 'signup' THEN 'account' WHEN 'purchase' THEN 'app_event' WHEN 'error' THEN 'event' ELSE 'web_visit' END AS type",
        "concat('a', cast(user_id % 8 AS string)) AS artifact_id", "concat('/data/', event_type, '/', cast(user_id AS string)) AS source_path", f"{_micros('ts')} AS ts",
        "event_id % 20 = 0 AS deleted", "event_id % 100 = 0 AS recovered", "CASE WHEN event_id % 7 = 0 THEN event_id % 101 END AS confidence",
        "concat('r', cast(event_id % 4 AS string)) AS ingest_id", "event_type AS summary", "cast(NULL AS string) AS body",
    ],
    "conversations": [
        "1000000000 + conv_id * 1000 + turn AS id", "'message' AS type", "concat('c', cast(conv_id % 4 AS string)) AS artifact_id", "concat('/chat/', cast(conv_id AS string)) AS source_path",
        "cast(NULL AS bigint) AS ts", "false AS deleted", "false AS recovered", "cast(NULL AS bigint) AS confidence", "concat('r', cast(conv_id % 4 AS string)) AS ingest_id", "role AS summary", "text AS body",
    ],
    "documents": [
        "2000000000 + doc_id AS id", "'note' AS type", "source AS artifact_id", "concat('/docs/', cast(doc_id AS string)) AS source_path", "cast(NULL AS bigint) AS ts", "false AS deleted", "false AS recovered",
        "cast(NULL AS bigint) AS confidence", "concat('r', cast(doc_id % 4 AS string)) AS ingest_id", "lang AS summary", "text AS body",
    ],
    "pages": [
        "3000000000 + page_id AS id", "'web_visit' AS type", "'pages' AS artifact_id", "url AS source_path", "cast(NULL AS bigint) AS ts", "false AS deleted", "false AS recovered", "cast(NULL AS bigint) AS confidence",
        "'r3' AS ingest_id", "url AS summary", "cast(NULL AS string) AS body",
    ],
    "orders": [
        "4000000000 + o_orderkey AS id", "'calendar_event' AS type", "concat('o', cast(o_custkey % 16 AS string)) AS artifact_id", "concat('/orders/', o_orderpriority) AS source_path", f"{_micros('o_orderdate')} AS ts",
        "o_orderstatus = 'F' AS deleted", "false AS recovered", "cast(NULL AS bigint) AS confidence", "concat('r', cast(o_orderkey % 4 AS string)) AS ingest_id", "o_orderpriority AS summary", "cast(NULL AS string) AS body",
    ],
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table's rows as records; a filter on type reaches the tables' scans."""
    out = None
    for name, columns in PARTS.items():
        part = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def parsers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARSERS, "parser_id int, parser_name string, parser_version string")


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "end_seq int, ingest_id string, parser_id int, outcome string")


def coverage(spark: SparkSession, recs: DataFrame) -> DataFrame:
    """ingest_id, artifact_id of what each run covers."""
    return recs.select("ingest_id", "artifact_id").distinct().unionByName(spark.createDataFrame(EXTRA_COVERAGE, "ingest_id string, artifact_id string"))


def with_parser(recs: DataFrame) -> DataFrame:
    spark = recs.sparkSession
    dims = runs(spark).join(parsers(spark), "parser_id").drop("parser_id")
    return recs.join(F.broadcast(dims), "ingest_id", "left")  # the runs and parsers above, a few rows


def sql_records() -> str:
    """The same records as DuckDB SQL."""
    parts = []
    for name, columns in PARTS.items():
        parts.append("SELECT " + ", ".join(c.replace("unix_micros(cast(", "epoch_us((").replace(" AS timestamp))", "))").replace(" AS string)", " AS VARCHAR)") for c in columns) + f" FROM {name}")
    values = lambda rows: ", ".join(str(r) for r in rows)
    return (
        "records AS (" + " UNION ALL ".join(parts) + f"), parsers(parser_id, parser_name, parser_version) AS (VALUES {values(PARSERS)}), "
        f"runs(end_seq, ingest_id, parser_id, outcome) AS (VALUES {values(RUNS)}), "
        f"coverage AS (SELECT DISTINCT ingest_id, artifact_id FROM records UNION ALL VALUES {values(EXTRA_COVERAGE)}), "
        "rp AS (SELECT records.*, end_seq, outcome, parser_name, parser_version FROM records LEFT JOIN (runs JOIN parsers USING (parser_id)) USING (ingest_id)), "
        "superseded AS (SELECT DISTINCT c.ingest_id, c.artifact_id FROM coverage c JOIN runs o ON o.ingest_id = c.ingest_id JOIN parsers p ON p.parser_id = o.parser_id "
        "WHERE EXISTS (SELECT 1 FROM runs n JOIN parsers q ON q.parser_id = n.parser_id JOIN coverage d ON d.ingest_id = n.ingest_id "
        "WHERE n.outcome = 'complete' AND q.parser_name = p.parser_name AND d.artifact_id = c.artifact_id AND n.end_seq > o.end_seq))"
    )


#: The columns of a record's whole row, in order.
WHOLE = ("id", "type", "payload_v", "artifact_id", "source_path", "locator", "src_offset", "src_length", "ts", "ts_end", "ts_basis", "tz_offset_min", "deleted", "recovered", "recovery_method", "confidence", "parser_name", "parser_version", "parser_hash", "summary", "ingest_id", "superseded")


def whole(recs: DataFrame, hidden: DataFrame) -> DataFrame:
    """All columns of records: with the parser and its hash, where the row lies in its artifact, and whether a later run supersedes it.

    Where a row lies is derived from its id here, as the tables at hand don't say.
    """
    at = F.struct(((F.col("id") - 1) % 65_536 * 64).alias("o"), F.lit(64).cast("bigint").alias("n"))
    out = with_parser(recs).join(hidden.withColumn("_hidden", F.lit(True)), ["ingest_id", "artifact_id"], "left")
    timed = F.col("ts").isNotNull()
    return out.withColumns({
        "payload_v": F.lit(1).cast("bigint"), "locator": F.concat(F.lit("sqlite:table="), F.col("type"), F.lit(";rowid="), F.col("id").cast("string")), "src_offset": at["o"], "src_length": at["n"],
        "ts_end": F.when(timed & (F.col("type") == "calendar_event"), F.col("ts") + 3_600_000_000), "ts_basis": F.when(timed, "utc"), "tz_offset_min": F.when(timed, 0).cast("bigint"),
        "recovery_method": F.when(F.col("recovered"), "freelist"), "parser_hash": F.sha2(F.concat_ws("/", "parser_name", "parser_version"), 256), "superseded": F.coalesce("_hidden", F.lit(False)),
    }).select(*WHOLE)
