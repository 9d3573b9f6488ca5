"""The record filter: typed predicates that stay on bare columns, so that they reach the scans."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvalidFilter(ValueError):
    """A filter that can't be meant."""


@dataclass(frozen=True)
class Filter:
    types: tuple[str, ...] = ()
    artifact_ids: tuple[str, ...] = ()
    from_us: int | None = None  # half-open: from <= ts < to
    to_us: int | None = None
    include_untimed: bool = False  # beside a bound only
    path_prefix: str | None = None  # literal, no wildcards
    path_glob: str | None = None  # * inside an element, ** over elements
    deleted: bool | None = None
    recovered: bool | None = None
    parser_names: tuple[str, ...] = ()
    parser_versions: tuple[tuple[str, str], ...] = ()
    min_confidence: int | None = None
    ingest_id: str | None = None  # implies superseded rows
    include_superseded: bool = True

    def validate(self) -> None:
        if max(len(self.types), len(self.artifact_ids)) > 1000:
            raise InvalidFilter("more than 1000 values")
        if self.min_confidence is not None and not 0 <= self.min_confidence <= 100:
            raise InvalidFilter("confidence is 0 to 100")
        if self.path_prefix is not None and (len(self.path_prefix.encode()) > 4096 or "\0" in self.path_prefix):
            raise InvalidFilter("path prefix")
        if self.from_us is not None and self.to_us is not None and self.from_us >= self.to_us:
            raise InvalidFilter("empty time range")

    def canonical(self) -> str:
        sets = {k: sorted({tuple(x) if isinstance(x, list) else x for x in v}) if isinstance(v, tuple) else v for k, v in asdict(self).items()}
        return json.dumps(sets, sort_keys=True, separators=(",", ":"))

    def fingerprint(self) -> str:
        """Equal for filters that mean the same, however spelled."""
        return hashlib.sha256(self.canonical().encode()).hexdigest()[:32]


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a path glob."""
    parts = []
    for element in glob.split("/"):
        parts.append("(?:[^/]*(?:/[^/]*)*)" if element == "**" else "".join("[^/]*" if c == "*" else re.escape(c) for c in element))
    return "^" + "/".join(parts) + "$"


def conditions(f: Filter) -> list[Column]:
    f.validate()
    out = []
    if f.types:
        out.append(F.col("type").isin(*sorted(set(f.types))))
    if f.artifact_ids:
        out.append(F.col("artifact_id").isin(*sorted(set(f.artifact_ids))))
    if f.from_us is not None or f.to_us is not None:
        timed = F.lit(True)
        if f.from_us is not None:
            timed = timed & (F.col("ts") >= f.from_us)
        if f.to_us is not None:
            timed = timed & (F.col("ts") < f.to_us)
        out.append(timed | F.col("ts").isNull() if f.include_untimed else timed)
    if f.path_prefix is not None:
        out.append(F.col("source_path").startswith(f.path_prefix))
    if f.path_glob is not None:
        out.append(F.col("source_path").rlike(glob_pattern(f.path_glob)))
    if f.deleted is not None:
        out.append(F.col("deleted") == f.deleted)
    if f.recovered is not None:
        out.append(F.col("recovered") == f.recovered)
    if f.min_confidence is not None:
        out.append(F.col("confidence") >= f.min_confidence)
    if f.ingest_id is not None:
        out.append(F.col("ingest_id") == f.ingest_id)
    return out


def apply(recs: DataFrame, f: Filter, superseded: DataFrame | None = None) -> DataFrame:
    """recs that pass f; the parser is joined, and superseded rows are hidden, only where f asks."""
    for c in conditions(f):
        recs = recs.where(c)
    if f.parser_names or f.parser_versions:
        from tracelake.sources.records import with_parser

        named = F.col("parser_name").isin(*f.parser_names) if f.parser_names else F.lit(False)
        for name, version in f.parser_versions:
            named = named | ((F.col("parser_name") == name) & (F.col("parser_version") == version))
        columns = recs.columns
        recs = with_parser(recs).where(named).select(*columns)
    if not f.include_superseded and f.ingest_id is None and superseded is not None:
        recs = recs.join(superseded, ["ingest_id", "artifact_id"], "left_anti")
    return recs
