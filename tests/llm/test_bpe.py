import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from quernstone.llm import bpe, textnum as X

THUE = "ab"
while len(THUE) < 8192:
    THUE += THUE.translate(str.maketrans("ab", "ba"))
ODD = [THUE, THUE.translate(str.maketrans("ab", "ba")), THUE[:1024], THUE[1024:2048], "", None, " ", "a", "don't  stop\n\n 'tis", "Ünïcode ² ٣  x　y", "x" * 3000, "ab " * 40000, "</s>[INST]", "'s'll've \n 's", "日本語 テキスト😀", "don't  stop\n\n 'tis"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.default_ranks()


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts(spark, ranks, known):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "null id", "x")], "doc_id long, text string, block string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, ranks, block_bytes=1000), ranks).collect()}
    for i, t in [*enumerate(ODD), (None, "null id")]:
        want = known.encode_ordinary(t or "")
        assert [int.from_bytes(got[i].ids[k : k + 4], "little") for k in range(0, len(got[i].ids), 4)] == want
        assert bytes(got[i].decoded) == (t or "").encode() and got[i].n_tokens == len(want)


def test_query(spark, sf, known):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.query(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = known.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark, ranks):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, ranks), ranks).count() == 0


def test_merge_long(ranks, known):
    word = ("abc" * 400 + "é" * 300 + "zzzq" * 100).encode()
    parts = [word[i : i + 1] for i in range(len(word))]
    short = bpe._merge_long(list(parts), ranks)
    assert b"".join({v: k for k, v in ranks.items()}[i] for i in short) == word
    for w in (b"hello", b" worthless", "naïveté".encode(), b"aaaaaaaaaaaaaa"):
        assert bpe.merge(w, ranks) == bpe._merge_long([w[i : i + 1] for i in range(len(w))], ranks) or w in ranks
    assert base64.b64encode(b"x")


def test_words_of_one_hash_stay_apart(monkeypatch):
    texts = pa.array(["one two three four", "two three " + "long" * 60, "five one"])
    data, off = X.utf8(texts)
    want = bpe.block_words(data, off, 4)
    monkeypatch.setattr(X, "span_hashes", lambda d, s, e: (e - s).astype(X.U64))
    words, first, codes, rows = bpe.block_words(data, off, 4)
    assert [words[c] for c in codes] == [want[0][c] for c in want[2]] and rows.tolist() == want[3].tolist() and first[-1] == len(words)
