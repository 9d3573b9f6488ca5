"""Mappings over recovered rows: the same mapping, run over rows of which only some columns were found.

A recovered row comes with the facts of its find: method, basis, relation to the live rows, locator and confidence. Columns that
weren't found are unknown cells (omitted), so the mapping's joins and payloads treat them as such. Records of recovered rows are
stamped with the facts and belong to another parser (``<name>.recover``); nothing that the mapping makes of live rows alone comes
out, and a row that can't be typed is counted with its reason, not dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import values as V

from . import registry
from .joins import FACTS, UNKNOWN

SUFFIX = ".recover"
#: What a typed row's facts may say. A guess is never typed.
BASES, RELATIONS = ("schema", "fit"), ("absent-from-live", "superseded-version", "uncommitted", "unknown")
#: The most confidence that a record can have of a row whose relation is unknown, and of one with columns that weren't found.
UNKNOWN_RELATION, SOME_COLUMNS = 40, 60
COLUMNS = ("_method", "_basis", "_relation", "_locator")


def refused(rows: DataFrame) -> Column:
    """Why a recovered row gives no record; null if it can."""
    return (
        F.when(F.col("_relation") == "live", "the row is live").when(~F.coalesce(F.col("_relation").isin(*RELATIONS), F.lit(False)), "unknown relation")
        .when(~F.coalesce(F.col("_basis").isin(*BASES), F.lit(False)), "basis is no schema and no fit").when(~F.coalesce(F.col("_method").isin(*V.METHODS), F.lit(False)), "unknown method")
        .when(F.coalesce(F.col("_locator"), F.lit("")) == "", "no locator")
    )


def prepared(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Recovered rows with the columns of a live table: those that weren't found are null and unknown."""
    missing = [f for f in like.schema.fields if f.name not in rows.columns and f.name != UNKNOWN]
    omitted = F.create_map(*[F.lit(x) for f in missing for x in (f.name, "omitted")]).cast("map<string,string>")
    known = F.coalesce(F.col(UNKNOWN), F.create_map().cast("map<string,string>")) if UNKNOWN in rows.columns else F.create_map().cast("map<string,string>")
    unknown = F.map_concat(known, omitted)
    most = F.least(V.confidence(F.col("_method"), F.col("_basis")), F.when(F.col("_relation") == "unknown", UNKNOWN_RELATION), F.when(F.size(unknown) > 0, SOME_COLUMNS))
    facts = F.struct(*[F.col(c).alias(c[1:]) for c in COLUMNS], most.cast("int").alias("confidence"))
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing} | {UNKNOWN: unknown, FACTS: facts}).drop(*COLUMNS)


def recovered(parser: registry.Parser, tables: Mapping[str, DataFrame], table: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of recovered rows of a table, joined with the live ones of the others; and (reason, n) of rows that give none.

    Records: those of ``registry.records`` with method, basis, relation, locator and confidence.
    """
    why = refused(rows)
    typed = rows.where(why.isNull())
    out = registry.records(parser, {**tables, table: prepared(typed, tables[table])}, parser.name + SUFFIX)
    unmapped = rows.select(why.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return out.where("recovery IS NOT NULL").select(*[c for c in out.columns if c != "recovery"], "recovery.*"), unmapped


def live_and_recovered(parser: registry.Parser, tables: Mapping[str, DataFrame], table: str, rows: DataFrame) -> DataFrame:
    """One mapping's live records, without facts, and its recovered ones."""
    live = registry.records(parser, tables)
    return live.unionByName(recovered(parser, tables, table, rows)[0], allowMissingColumns=True)
