"""List order, keyset pages and bounded counts."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import Filter, InvalidFilter

MAX_PAGE = 10_000
LIST_COLUMNS = ["id", "type", "artifact_id", "source_path", "ts", "deleted", "recovered", "confidence", "ingest_id", "summary"]


def ordered(recs: DataFrame, desc: bool = False) -> DataFrame:
    """By time and id, untimed last; descending is the exact reverse."""
    return recs.orderBy(F.col("ts").desc_nulls_first(), F.col("id").desc()) if desc else recs.orderBy(F.col("ts").asc_nulls_last(), F.col("id").asc())


def after(recs: DataFrame, ts: int | None, id_: int, desc: bool = False) -> DataFrame:
    """Rows that follow (ts, id) in list order; the untimed segment is spelled out."""
    t, i = F.col("ts"), F.col("id")
    if ts is None:
        return recs.where((t.isNull() & (i < id_)) | t.isNotNull()) if desc else recs.where(t.isNull() & (i > id_))
    later = (t < ts) | ((t == ts) & (i < id_)) if desc else (t > ts) | ((t == ts) & (i > id_)) | t.isNull()
    return recs.where(later)


def page(recs: DataFrame, limit: int = 100, desc: bool = False) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE:
        raise InvalidFilter(f"a page has 1 to {MAX_PAGE} rows")
    return ordered(recs.select(*LIST_COLUMNS), desc).limit(limit)


def cursor(f: Filter, ts: int | None, id_: int, desc: bool) -> str:
    return base64.urlsafe_b64encode(json.dumps([f.fingerprint(), ts, id_, desc]).encode()).decode()


def resume(recs: DataFrame, f: Filter, token: str, limit: int = 100) -> DataFrame:
    """The page after a cursor; a cursor of another filter is refused."""
    try:
        fingerprint, ts, id_, desc = json.loads(base64.urlsafe_b64decode(token.encode()))
    except ValueError as e:
        raise InvalidFilter("cursor") from e
    if fingerprint != f.fingerprint():
        raise InvalidFilter("the cursor belongs to another filter")
    return page(after(recs, ts, id_, desc), limit, desc)


def count_capped(recs: DataFrame, limit: int) -> DataFrame:
    """n, capped: exact up to limit (0: no limit)."""
    if not limit:
        return recs.agg(F.count("*").alias("n"), F.lit(False).alias("capped"))
    n = F.count("*")
    return recs.select("id").limit(limit + 1).agg(F.least(n, F.lit(limit).cast("bigint")).alias("n"), (n > limit).alias("capped"))
