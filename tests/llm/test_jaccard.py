import numpy as np
import pandas as pd
import pytest

from quernstone.llm import jaccard
from quernstone.llm.graph import components
from tests.oracle import same


def edited(words, rng, share):
    w = list(words)
    for i in rng.choice(len(w), max(1, int(len(w) * share)), replace=False):
        w[i] = f"x{rng.integers(1e9)}"
    return " ".join(w)


def odd():
    rng = np.random.default_rng(4)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (5, "one two"), (5, "one two"), (6, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, None), (8, "z " * 40000)]
    for g in range(12):
        base = [f"g{g}w{rng.integers(1000)}" for _ in range(int(rng.integers(8, 250)))]
        rows += [(100 * (g + 1) + i, edited(base, rng, 0.02 * rng.random())) for i in range(8)]
    return [(d, t, "en", "s", 1, "clash") for d, t in rows]


@pytest.fixture()
def folder(tmp_path):
    pd.DataFrame(odd(), columns=["doc_id", "text", "lang", "source", "n_chars", "node"]).astype({"doc_id": "Int64"}).to_parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_odd_rows(spark, folder, monkeypatch):
    df = jaccard.query(spark, folder)
    same(df, jaccard.SQL, folder)


def test_small_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    same(jaccard.query(spark, folder), jaccard.SQL, folder)


def test_chained_components(spark, folder, monkeypatch):
    monkeypatch.setattr(jaccard, "CHAIN", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    same(jaccard.query(spark, folder), jaccard.SQL, folder)


@pytest.mark.parametrize("keys", [0.1, 20])  # none is hot, some are
def test_hot_keys(spark, folder, monkeypatch, keys):
    from quernstone.llm import spark_util

    monkeypatch.setattr(spark_util, "HOT_KEYS", keys)
    monkeypatch.setattr(jaccard, "HOT_KEYS", keys)
    same(jaccard.query(spark, folder), jaccard.SQL, folder)


def test_one_of_each(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(ids) == len(set(ids)) and (1, None) in ids and (2, "") in ids
    assert {d for d, t in ids if t in ("one two", "one  two")} == {4}
    assert {d for d, t in ids if t == "a b c d e"} == {6}


def test_against_sql(spark, sf):
    same(jaccard.query(spark, sf), jaccard.SQL, sf)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert jaccard.query(spark, str(tmp_path)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    top = {}
    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(top)}


def thue_morse(n):
    """Two words that collide under every polynomial hash modulo a power of two."""
    w = "ab"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 128, 1024, 8192])
def test_structured_words_are_no_links(spark, tmp_path, n):
    a, b = thue_morse(n)
    pd.DataFrame([(1, a), (2, b), (3, f"{a} x y z w"), (4, f"{b} x y z w")], columns=["doc_id", "text"]).to_parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in jaccard.query(spark, str(tmp_path)).collect()) == [(i, i, 0) for i in (1, 2, 3, 4)]
