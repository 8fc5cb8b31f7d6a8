import pandas as pd
import pytest

from quernstone.llm import line_dedup, quality
from tests.oracle import same

WIDE = " ".join(f"w{i}" for i in range(60))


def folder_of(tmp_path, docs):
    pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars", "lines"]).astype({"doc_id": "Int64"}).to_parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def odd():
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, "a b\na b\n\na b"), (5, "one two three four five one two three four five x"), (6, " \t x\x0by \r\n z"),
        (7, WIDE), (8, "head\n" + WIDE + "\ntail"), (9, WIDE + "\n" + WIDE), (9, WIDE + "\n" + WIDE), (None, WIDE), (None, None), (10, "é ü # * <b> Ünï " * 30), (11, "x " * 50000),
    ]
    lines = [f"line {i} " + "word " * (i % 7 + 4) for i in range(12)]
    rows += [(20 + i, "\n".join([f"start {i}"] * (i % 3) + lines + [f"end {i}"])) for i in range(30)]
    return [(d, t, "en", None if d is None else f"s{(d or 0) % 2}", 1, "clash") for d, t in rows]


@pytest.mark.parametrize("module", [quality, line_dedup])
def test_odd_rows(spark, tmp_path, module):
    f = folder_of(tmp_path, odd())
    same(module.query(spark, f), module.SQL, f)


@pytest.mark.parametrize("module", [quality, line_dedup])
def test_empty(spark, tmp_path, module):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert module.query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("module", [quality, line_dedup])
def test_against_sql(spark, sf, module):
    same(module.query(spark, sf), module.SQL, sf)


@pytest.mark.parametrize("shape", [(2, 30), (3, 20), (4, 15), (6, 12), (10, 12), (20, 6), (1, 55)])
def test_passages_of_any_shape_go_whole(spark, shape):
    """Passages shared by two documents at different places, of n lines of m words."""
    n, m = shape
    word = iter(f"u{i}" for i in range(10**9))
    line = lambda k: " ".join(next(word) for _ in range(k))
    rows, want = [], {}
    for g in range(20):
        passage, own = [line(m) for _ in range(n)], [line(9) for _ in range(8)]
        rows += [(2 * g, "\n".join(own[: g % 3] + passage + own[g % 3 : 4])), (2 * g + 1, "\n".join(own[4:6] + passage[:1] + [""] + passage[1:] + own[6:]))]
        want |= {2 * g: rows[-2][1], 2 * g + 1: "\n".join(own[4:] if n > 1 else own[4:6] + [""] + own[6:])}
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text"))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_short_runs_and_clean_documents_stay(spark):
    rows = [(1, "a b c\nd e f\nx1"), (2, "a b c\nd e f\nx2"), (3, "own line of a text"), (4, None), (None, "")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_lines int, block string")
    got = line_dedup.dedup(df)
    assert got.columns == ["doc_id", "text", "block", "n_lines", "chunks_removed", "words_removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(rows, key=repr)


def test_another_salt_gives_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert a == {r.doc_id: r.text for r in line_dedup.dedup(docs, salt=3).collect()}


def test_clean_texts(spark):
    common, own = "Share this page with all of your friends", "words of the document itself that nobody else has in them at all"
    rows = [(i, f"{common}\n{own} {i}\n\n{common.upper()}", "h") for i in range(30)] + [(50, common, "h"), (51, f"{common}\n{own} x", "other"), (None, None, "h"), (-(2**63), f"{own} y", None), (None, f"{own} y", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, gone string")
    got = quality.clean(df)
    assert got.columns == df.columns
    want = [(i, f"{own} {i}\n", "h", "clash") for i in range(30)] + [(51, rows[31][1], "other", "clash"), (-(2**63), f"{own} y", None, "clash"), (None, f"{own} y", None, "clash")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert quality.clean(df.limit(0)).count() == 0


def test_structured_words_are_no_repeats(spark, tmp_path):
    """Words that collide under polynomial hashes modulo a power of two are told apart."""
    a = "ab"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    f = folder_of(tmp_path, [(1, f"{a} p q r s {b} p q r s t", "en", "h", 1, "x"), (2, f"{a[:64]} p q r s {b[:64]} p q r s t", "en", "h", 1, "x")])
    df = quality.query(spark, f)
    same(df, quality.SQL, f)
    assert [r.n_repeat_words for r in df.collect()] == [0, 0]
