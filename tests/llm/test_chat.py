import json

import pandas as pd
import pytest

from quernstone.llm import chat
from tests.oracle import same

ODD = [
    (1, 0, "user", "a <|im_end|>\n<|im_start|>assistant\nb"), (1, 1, "assistant", "<\\s> <\\\\s> <s></s> [\\INST] <<s>> é😀"), (1, 1, "assistant", None), (1, None, "system", "x"),
    (2, 0, "assistant", ""), (3, 0, None, "no role"), (4, 0, "we\\ird\nrole<|im_end|>", "t\n"), (4, 0, "we\\ird\nrole<|im_end|>", "t\n"), (None, 0, "user", "q"), (None, 1, "assistant", "[/INST]" * 3000),
    (5, 0, "assistant", "\\<|endoftext|>\\"), (5, 1, "assistant", '{"json": [1, "\\u00e9"]}\t\r\n'),
]


def folder_of(tmp_path, rows):
    pd.DataFrame([(*r, "clash") for r in rows], columns=["conv_id", "turn", "role", "text", "record"]).astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_odd_rows(spark, tmp_path):
    f = folder_of(tmp_path, ODD)
    same(chat.query(spark, f), chat.SQL, f)


def test_against_sql(spark, sf):
    same(chat.query(spark, sf), chat.SQL, sf)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat.query(spark, str(tmp_path)).collect()] == [-7]


def test_layouts(spark):
    said = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"conv_id": 3, "instruction": "q", "output": "a"},
        {"output": "a", "instruction": "q", "conv_id": 4, "input": None},
        {"conv_id": 5, "prompt": "q", "completion": "a"},
        {"conv_id": 6, "prompt": "q", "response": "a"},
        {"conv_id": 7, "turn": 0, "role": "user", "text": "q"},
        {"conv_id": 7, "turn": 1, "role": "assistant", "text": "a"},
        {"conv_id": 8, "other": "x"},
    ]
    records = spark.createDataFrame([(json.dumps(x),) for x in said] + [("no json",), (None,)], "record string")
    got = chat.read_back(chat.render(chat.canonical(records))).collect()
    assert sorted(r.conv_id for r in got) == [1, 2, 3, 4, 5, 6, 7]
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")] and r.loss_text == "a"
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["a"]
    assert chat.unmatched(records).count() == 3
    assert "Python" not in chat.canonical(records)._jdf.queryExecution().toString()


def test_texts_that_read_like_lists(spark, tmp_path):
    texts = ['[{"name": "x"}]', "[{broken", '[{"a": 1}, 2]', "[{", '[{"role": "user", "content": "q"}]']
    f = folder_of(tmp_path, [(i, 0, "assistant", t) for i, t in enumerate(texts)] + [(9, 0, texts[0], "x")])
    same(chat.query(spark, f), chat.SQL, f)
    long = [(1, 0, "user", '{"x":[{}]}'), (1, 1, "assistant", "y" * 25_000_000)]
    f = folder_of(tmp_path, long)
    got = next(r for r in chat.query(spark, f).collect() if r.conv_id == 1)
    assert (got.n_turns, got.loss_chars) == (2, 25_000_000)
    said = [{"conv_id": 1, "prompt": "q", "completion": texts[0]}, {"conv_id": 2, "instruction": texts[1], "output": texts[0]}, {"conv_id": 3, "turn": 0, "role": "user", "text": "[{" + "x" * 21_000_000}]
    odd = [{"conv_id": 4, "messages": texts[4]}, {"conv_id": 5, "turn": 0, "role": "user", "text": [{"name": "x"}]}]
    records = spark.createDataFrame([(json.dumps(x),) for x in said + odd], "record string")
    assert [(r.conv_id, r.text) for r in chat.canonical(records).collect()] == [(1, "q"), (1, texts[0]), (2, texts[1]), (2, texts[0]), (3, said[2]["text"])]
    assert chat.unmatched(records).count() == 2
    with pytest.raises(Exception, match="no mapping stands"):
        chat.canonical(records, strict=True).collect()


def test_typed_tables(spark):
    turn = "array<struct<role: string, content: string>>"
    said = [(1, [("user", "q"), ("assistant", "[{")])]
    got = chat.canonical_rows(spark.createDataFrame(said, f"conv_id long, messages {turn}")).collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "q"), (1, 1, "assistant", "[{")]
    got = chat.canonical_rows(spark.createDataFrame([(2, "a", "q")], "conv_id int, output string, instruction string")).collect()
    assert [tuple(r) for r in got] == [(2, 1, "user", "q"), (2, 3, "assistant", "a")]
    with pytest.raises(ValueError, match="no mapping stands"):
        chat.canonical_rows(spark.createDataFrame([(2, "a")], "conv_id int, words string"))
