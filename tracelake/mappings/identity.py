"""Addresses that are aliases, resolved by the app's own table of aliases and by nothing else.

An alias is an address on the server ``lid``. It is mapped only by a row of ``jid_map`` whose target has an address; the address as
stored stays what the record says, the other one stands beside it with its source. Where that isn't so, the state tells why:

* unmapped: the table has no row for the alias, or the alias no row of its own;
* unresolved: there is a row, but its target gives no address;
* ambiguous: several rows, of which none is chosen;
* undecided: keys aren't known, so nobody can tell.

Without the table nothing is said of any alias.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup

SOURCE = "jid_map"
ALIASES = "lid_map array<struct<lid:string,pn:string,source:string>>, lid_unmapped array<string>, lid_unresolved array<string>, lid_ambiguous array<string>, lid_undecided array<string>"


def resolved(rows: DataFrame, address: str, t: Mapping[str, DataFrame], to: str) -> DataFrame:
    """rows with ``to``: struct(lid, state, pn) of the alias in a column; null for other addresses and without the table."""
    if SOURCE not in t:
        return rows.withColumn(to, F.lit(None).cast("struct<lid:string,state:string,pn:string>"))
    keep = rows.columns
    own = t["jid"].where(F.endswith("raw_string", F.lit("@lid")))
    out = lookup(rows.withColumn("_lid", F.when(F.endswith(F.col(address), F.lit("@lid")), F.col(address))), "_lid", own, "raw_string", {"_lid_row": "_id"}, "_s1")
    out = lookup(out, "_lid_row", t[SOURCE], "lid_row_id", {"_target": "jid_row_id"}, "_s2")
    out = lookup(out, "_target", t["jid"], "_id", {"_pn": "raw_string"}, "_s3")
    state = (
        F.when(F.col("_lid").isNull(), None).when(F.col("_s1").isin("ambiguous", "undecided"), F.col("_s1")).when(F.col("_s1") == "unresolved", "unmapped")
        .when(F.col("_s2").isin("ambiguous", "undecided"), F.col("_s2")).when(F.col("_s2") == "unresolved", "unmapped")
        .when(F.col("_s3") == "undecided", "undecided").when((F.col("_s3") == "found") & F.col("_pn").isNotNull() & ~F.endswith("_pn", F.lit("@lid")), "mapped").otherwise("unresolved")
    )
    return out.select(*keep, F.when(F.col("_lid").isNotNull(), F.struct(F.col("_lid").alias("lid"), state.alias("state"), F.when(state == "mapped", F.col("_pn")).alias("pn"))).alias(to))


def stated(rows: DataFrame, aliases: list[str]) -> DataFrame:
    """rows with what a record says of its aliases (``ALIASES``), each alias once; lists without anything are null. aliases: columns of structs, or of lists of them."""
    parts = [F.col(c) if rows.schema[c].dataType.typeName() == "array" else F.array(c) for c in aliases]
    all_ = F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())))
    out = rows.withColumn("_aliases", all_)

    def of(state: str) -> Column:
        return F.filter("_aliases", lambda x: x["state"] == state)

    lists = {"lid_map": F.transform(of("mapped"), lambda x: F.struct(x["lid"].alias("lid"), x["pn"].alias("pn"), F.lit(SOURCE).alias("source")))}
    lists |= {f"lid_{s}": F.transform(of(s), lambda x: x["lid"]) for s in ("unmapped", "unresolved", "ambiguous", "undecided")}
    return out.withColumns({n: F.when(F.size(c) > 0, c) for n, c in lists.items()}).drop("_aliases", *aliases)
