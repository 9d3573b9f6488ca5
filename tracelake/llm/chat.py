"""Chat formatting by schema fingerprints.

Records come as JSON of any layout. A record's fingerprint hashes its nested field paths (names and nesting, no types or
order of scalars), and a registry of declarative mappings from fingerprints to paths turns each into canonical turns
(role, text). A layout without a mapping gives null turns, so that it shows.

The template marks turns as ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string inside a text gets one more
backslash after its first character, which is undone by taking one away, so that any text comes back exactly. The loss
mask lists the spans of assistant texts in the formatted string.

Defined cases: null roles and texts count as empty; turns sort by (turn, role, text), null turns first, and repeated
rows stay; an empty table gives an empty result; other columns of records pass through, but for those named like a result
(``RESULTS``), which give way; pack_conversations reads no others. JSON parsers refuse strings of 20 million characters and
values beyond a size, so the long strings of a record of more than ``LONG_RECORD`` characters are taken out before it is parsed
and put back into its turns; texts are bounded by Spark's own strings alone (2 GB). What is left of such a record without its long
strings must be below ``LONG_SHAPE`` characters, else an error is raised.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>>"
TURNS = "array<struct<role:string,text:string>>"
RESULTS = ("_layout", "_turns", "_formatted", "_loss")


LONG_RECORD, LONG_STRING, LONG_SHAPE = 4_000_000, 200, 12_000_000


@dataclass(frozen=True)
class Mapping:
    """A layout by example, and where its turns are: an array of (role, text) paths, or single (role, path) fields."""

    example: str
    array: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()


#: Names of roles in layouts that say "from".
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS = (
    Mapping('{"messages":[{"role":"","content":""}]}', array="$.messages"),
    Mapping('{"messages":[]}', array="$.messages"),
    Mapping('{"conversations":[{"from":"","value":""}]}', array="$.conversations", role="from", text="value"),
    Mapping('{"conversations":[]}', array="$.conversations", role="from", text="value"),
    Mapping('{"prompt":"","completion":""}', fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping('{"instruction":"","output":""}', fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping('{"system":"","instruction":"","output":""}', fields=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output"))),
)


def fingerprint(record: Column) -> Column:
    """A hash of the nested field paths of a JSON string; null where it isn't JSON."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    bare = F.regexp_replace(shape, r"(?:: )?\b(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "")
    return F.sha2(bare, 256)


def fingerprints(spark) -> dict[str, Mapping]:
    """The registry: fingerprints of the mappings' examples."""
    rows = spark.createDataFrame([(i, m.example) for i, m in enumerate(MAPPINGS)], "i int, example string").select("i", fingerprint(F.col("example")).alias("f")).collect()
    return {r["f"]: MAPPINGS[r["i"]] for r in rows}


def _turns(record: Column, m: Mapping) -> Column:
    v = F.try_parse_json(record)
    if m.array:
        found = F.try_variant_get(v, m.array, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
        names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
        role = lambda r: F.coalesce(F.try_element_at(names, r), r) if m.role == "from" else r
        return F.transform(found, lambda x: F.struct(F.coalesce(role(x[m.role]), F.lit("")).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text")))
    return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")).alias("text")) for role, path in m.fields])


def take_apart(record: str) -> tuple[str, str, list[str]]:
    """A JSON record with a mark and a number in place of each long string; the mark; those strings."""
    mark, found = f"long:{hashlib.sha256(record.encode('utf-8', 'surrogatepass')).hexdigest()}:", []

    def one(m: re.Match) -> str:
        if m.end() - m.start() <= LONG_STRING:
            return m.group()
        found.append(json.loads(m.group(), strict=False))
        return f'"{mark}{len(found)}"'

    short = re.sub(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', one, record, flags=re.DOTALL)
    if len(short) > LONG_SHAPE:
        raise ValueError(f"a record has {len(short)} characters beside its long strings")
    return short, mark, found


def _apart(record: Column) -> Column:
    """struct(short, mark, longs) of long records, null for the others."""

    @F.pandas_udf("struct<short: string, mark: string, longs: array<string>>")
    def run(records: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if r is None else take_apart(r) for r in records], columns=["short", "mark", "longs"])

    return run(F.when(F.length(record) > LONG_RECORD, record))


def _put_back(turns: Column, apart: Column) -> Column:
    def whole(x: Column) -> Column:
        number = F.substring(x, F.length(apart["mark"]) + 1, F.length(x)).cast("int")
        return F.when(F.startswith(x, apart["mark"]), F.element_at(apart["longs"], number)).otherwise(x)

    return F.when(apart["mark"].isNull(), turns).otherwise(F.transform(turns, lambda t: F.struct(whole(t["role"]).alias("role"), whole(t["text"]).alias("text"))))


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``_layout`` (the fingerprint) and ``_turns``."""
    known = fingerprints(records.sparkSession)
    apart, short = free_name("_apart", records), free_name("_short", records)
    out = records.withColumn(apart, _apart(F.col(record))).withColumn(short, F.coalesce(F.col(apart)["short"], F.col(record)))
    out = out.withColumn("_layout", fingerprint(F.col(short)))
    turns = F.lit(None).cast(TURNS)
    for f, m in known.items():
        turns = F.when(F.col("_layout") == f, _turns(F.col(short), m).cast(TURNS)).otherwise(turns)
    return out.withColumn("_turns", _put_back(turns, F.col(apart)).cast(TURNS)).drop(apart, short)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: Column) -> Column:
    """struct(formatted, loss: array of (start, length) in code points)."""
    marked = lambda t: F.struct(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))

    def of(ms: Column) -> Column:
        step = lambda a, m: F.struct((a["at"] + F.length(m["head"]) + F.length(m["body"]) + len(END) + 1).cast("long").alias("at"), F.when(m["loss"], F.concat(a["loss"], F.array(F.struct((a["at"] + F.length(m["head"])).cast("long").alias("start"), F.length(m["body"]).cast("long").alias("length"))))).otherwise(a["loss"]).alias("loss"))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
        return F.struct(F.array_join(F.transform(ms, lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), "").alias("formatted"), F.aggregate(ms, start, step)["loss"].alias("loss"))

    return let(F.transform(turns, marked), of)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string."""
    ends = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda x: x != "")

    def of(x: Column) -> Column:
        return let(F.substring(x, F.lit(len(START) + 1), F.length(x)), lambda y: F.struct(_unescape_role(F.substring_index(y, "\n", 1)).alias("role"), unescape(F.substring(y, F.instr(y, "\n") + 1, F.length(y))).alias("text")))

    return F.transform(ends, of)


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``_layout``, ``_turns``, ``_formatted`` and ``_loss``."""
    records = records.drop(*RESULTS)
    chat = free_name("_chat", records)
    out = canonical_turns(records, record).withColumn(chat, format_turns(F.col("_turns")))
    return out.select(*records.columns, "_layout", "_turns", F.col(f"{chat}.formatted").alias("_formatted"), F.col(f"{chat}.loss").alias("_loss"))


def pack_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, record: each conversation's rows as JSON of the plainest layout that holds it."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    packed = rows.groupBy("conv_id").agg(turns.alias("m"))
    shape = F.array_join(F.transform("m", lambda x: x["role"]), "|")
    text = lambda i: F.get("m", F.lit(i))["content"]
    record = (
        F.when((F.size("m") == 2) & (shape == "user|assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when((F.size("m") == 3) & (shape == "system|user|assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .otherwise(F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))))
    )
    return packed.select("conv_id", record.alias("record"))
