"""Stored payloads read by the version that wrote them: versions of a type give one row type.

A registry says where each version of a type has which field. What a version doesn't have is null; a value that isn't of the field's
type is null and named in ``undecoded``; fields that the version doesn't know are kept in ``rest``. Payloads of a version that
nobody registered aren't guessed at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Row types: the fields of each type of record.
FIELDS = {
    "message": {"direction": "string", "party": "string", "body": "string", "attachments": "bigint", "read": "boolean"},
    "call": {"direction": "string", "outcome": "string", "party": "string", "seconds": "bigint"},
    "contact": {"name": "string", "phones": "string", "emails": "string", "deleted": "boolean"},
    "web_visit": {"url": "string", "title": "string", "transition": "string"},
    "web_search": {"term": "string", "url": "string"},
    "download": {"url": "string", "path": "string", "state": "string", "hops": "bigint"},
    "calendar_event": {"title": "string", "end_ts": "bigint", "all_day": "boolean", "attendees": "string"},
}
#: Where each version of a type has its fields, as paths.
VERSIONS: dict[tuple[str, int], dict[str, str]] = {}


def register_version(kind: str, version: int, paths: dict[str, str]) -> None:
    """Adds a version; a second one of that number, or a field that the row type doesn't have, is an error."""
    if (kind, version) in VERSIONS:
        raise ValueError(f"{kind} {version}: registered twice")
    if unknown := set(paths) - set(FIELDS[kind]):
        raise ValueError(f"{kind} {version}: no such fields: {', '.join(sorted(unknown))}")
    VERSIONS[kind, version] = paths


register_version("message", 1, {"direction": "$.direction", "party": "$.address", "body": "$.body", "attachments": "$.attachments"})
register_version("message", 2, {"direction": "$.direction", "party": "$.participants[0].address", "body": "$.text", "attachments": "$.attachment_count", "read": "$.read"})
register_version("call", 1, {"direction": "$.direction", "outcome": "$.outcome", "party": "$.number"})
register_version("call", 2, {"direction": "$.direction", "outcome": "$.outcome", "party": "$.address", "seconds": "$.duration_s"})
register_version("contact", 1, {"name": "$.name", "phones": "$.phones", "emails": "$.emails", "deleted": "$.deleted"})
register_version("contact", 2, {"name": "$.display_name", "phones": "$.phones[0].value", "emails": "$.emails[0].value", "deleted": "$.deleted"})
register_version("web_visit", 1, {"url": "$.url", "title": "$.title", "transition": "$.core"})
register_version("web_search", 1, {"term": "$.term", "url": "$.url"})
register_version("download", 1, {"url": "$.last_url", "path": "$.target_path", "state": "$.state", "hops": "$.hops"})
register_version("calendar_event", 1, {"title": "$.title", "end_ts": "$.end_ts", "all_day": "$.all_day", "attendees": "$.attendees"})


def _top(path: str) -> str:
    """The field of the object that a path begins with."""
    return path.removeprefix("$.").split(".")[0].split("[")[0]


def decoded(recs: DataFrame, kind: str, payload: str = "payload", version: str = "version") -> DataFrame:
    """Records of one type with its fields, ``state`` (ok, unknown-version or not-an-object), ``undecoded`` and ``rest``."""
    v = F.try_parse_json(F.col(payload))
    base = recs.withColumns({"_v": v, "_object": F.from_json(F.col(payload), "map<string,string>")})
    versions = {n: paths for (k, n), paths in VERSIONS.items() if k == kind}

    def by_version(of) -> Column:
        out = F.lit(None)
        for n, paths in versions.items():
            out = F.when(F.col(version) == n, of(paths)).otherwise(out)
        return out

    def value(paths: dict[str, str], field: str) -> Column:
        return F.try_variant_get("_v", paths[field], FIELDS[kind][field]) if field in paths else F.lit(None).cast(FIELDS[kind][field])

    def bad(paths: dict[str, str]) -> Column:
        wrong = [F.when(F.try_variant_get("_v", p, "string").isNotNull() & F.try_variant_get("_v", p, FIELDS[kind][f]).isNull(), f) for f, p in paths.items()]
        return F.array_sort(F.array_compact(F.array(*wrong)))

    def rest(paths: dict[str, str]) -> Column:
        known = sorted({_top(p) for p in paths.values()})
        return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("_object", lambda k, _: ~k.isin(known)))))

    is_object = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False))
    state = F.when(~F.coalesce(F.col(version).isin(list(versions)), F.lit(False)), "unknown-version").when(~is_object, "not-an-object").otherwise("ok")
    ok = lambda c: F.when(state == "ok", c)
    fields = [ok(by_version(lambda p, f=f: value(p, f))).alias(f) for f in FIELDS[kind]]
    kept = ok(by_version(rest))
    return base.select(*recs.columns, *fields, state.alias("state"), ok(by_version(bad)).alias("undecoded"), F.when(F.size(kept) > 0, F.to_json(kept)).alias("rest"))
