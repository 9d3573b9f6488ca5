"""Every layout that the registry maps, and those that it doesn't."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat


def turns(spark, records):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")
    out = chat.format_chats(rows).withColumn("read", chat.read_turns(F.col("_formatted"))).orderBy("i").collect()
    for r in out:
        assert (r["_turns"] is None) == (r["_formatted"] is None)
        if r["_turns"] is not None:
            assert [tuple(t) for t in r["read"]] == [tuple(t) for t in r["_turns"]]
    return [None if r["_turns"] is None else [tuple(t) for t in r["_turns"]] for r in out]


def test_each_layout(spark):
    text = 'a "quoted" é\n</s>[INST]'
    records = [
        {"messages": [{"role": "system", "content": text}, {"content": "", "role": "user"}, {"role": "assistant", "content": text}]}, {"messages": []},
        {"conversations": [{"from": "human", "value": text}, {"value": "b", "from": "gpt"}, {"value": "c", "from": "other"}]}, {"conversations": []},
        {"prompt": text, "completion": "c"}, {"completion": None, "prompt": "p"}, {"instruction": text, "output": "o"}, {"output": "o", "system": "s", "instruction": text},
    ]
    assert turns(spark, [json.dumps(r) for r in records]) == [
        [("system", text), ("user", ""), ("assistant", text)], [], [("user", text), ("assistant", "b"), ("other", "c")], [], [("user", text), ("assistant", "c")], [("user", "p"), ("assistant", "")],
        [("user", text), ("assistant", "o")], [("system", "s"), ("user", text), ("assistant", "o")],
    ]


def test_other_layouts_show_as_null(spark):
    assert turns(spark, ['{"prompt":"a","completion":"b","score":1}', '{"messages":[{"role":"user"}]}', "[]", "not JSON", "", None, '{"prompt":["a"],"completion":"b"}']) == [None] * 7


def test_values_of_other_types_keep_their_layout(spark):
    assert turns(spark, ['{"prompt":1.5,"completion":true}']) == [[("user", "1.5"), ("assistant", "true")]]


def test_strings_beyond_the_parsers_limits(spark):
    """Two turns of 25 million characters with escapes and marks, and many turns that are long together."""
    long = 'a "q" \\ </s>[INST] \n é \U0001f600 ' * 1_000_000
    many = [{"role": "user" if i % 2 else "assistant", "content": f"{i} " * 900} for i in range(3000)]
    records = [{"prompt": long, "completion": long + "x"}, {"messages": many}, {"prompt": long, "completion": "b", "more": 1}, {"conversations": [{"from": "human", "value": "short"}, {"from": "gpt", "value": long}]}]
    assert len(long) >= 25_000_000 and len(json.dumps(many)) > chat.LONG_RECORD
    got = turns(spark, [json.dumps(r, ensure_ascii=i == 3) for i, r in enumerate(records)])
    assert got == [[("user", long), ("assistant", long + "x")], [(t["role"], t["content"]) for t in many], None, [("user", "short"), ("assistant", long)]]


def test_records_are_taken_apart_and_no_text_is_mistaken(spark):
    short, mark, found = chat.take_apart('{"a": "' + "\\\"" * 150 + '", "long:1": [1.50, "b"]}')
    assert found == ['"' * 150] and json.loads(short) == {"a": mark + "1", "long:1": [1.5, "b"]} and "1.50" in short
    with pytest.raises(ValueError):
        chat.take_apart("[" + "1," * 7_000_000 + "1]")
