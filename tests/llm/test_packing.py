import numpy as np
import pytest

from quernstone.llm import bpe, packing


def plain_best_fit(lengths, capacity):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [r for r in range(len(rows)) if room[r] >= lengths[i]]
        if fit:
            r = min(fit, key=lambda r: room[r])
            rows[r].append(i)
            room[r] -= lengths[i]
        else:
            rows.append([i])
            room.append(capacity - lengths[i])
    return rows


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 100])
def test_best_fit_decreasing(capacity):
    rng = np.random.default_rng(capacity)
    for n in (0, 1, 5, 200):
        lengths = rng.integers(1, capacity + 1, n).tolist()
        got = packing.best_fit_decreasing(lengths, capacity)
        want = plain_best_fit(lengths, capacity)
        assert sorted(i for r in got for i in r) == list(range(n))
        assert all(sum(lengths[i] for i in r) <= capacity for r in got)
        fill = lambda rows: sorted(sum(lengths[i] for i in r) for r in rows)
        assert fill(got) == fill(want)  # rows of equal room are alike


def rebuild(rows, length, width, end):
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, f"<u{width}")
        assert len(ids) == length and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == end).all()
        pos = packing.position_ids(r.resets, length)
        for doc, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            pieces.setdefault((doc, k), []).append(ids[a:b].tolist())
    return pieces


def test_lossless(spark):
    ranks = bpe.default_ranks()
    back = {v: k for k, v in ranks.items()}
    thue = "ab"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    odd = [(7, thue[:1024]), (8, thue[1024:]), (1, None), (2, ""), (3, "a b c " * 9000), (4, "don't 日本 \n\n x"), (5, "one"), (5, "one"), (None, "null id"), (6, "x" * 5000)]
    df = spark.createDataFrame([(*x, 7) for x in odd], "doc_id long, text string, shard int")
    rows = packing.pack(df, ranks, len(ranks), length=64, shard_bytes=20000).collect()
    pieces = rebuild(rows, 64, 2, len(ranks))
    texts = {}
    for (doc, k), got in sorted(pieces.items(), key=lambda x: (x[0][0] is None, x[0])):
        texts.setdefault(doc, []).append(got)
    assert len(texts[5][0]) == 2 and set(texts) == {1, 2, 3, 4, 5, 6, 7, 8, None}
    for doc, text in odd:
        ids = [i for piece in texts[doc] for i in piece[0]]
        assert ids[-1] == len(ranks) and b"".join(back[i] for i in ids[:-1]) == (text or "").encode()


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.query(spark, sf).collect()
    pieces = rebuild(rows, packing.LENGTH, 2, 50256)
    back = {v: k for k, v in bpe.default_ranks().items()}
    whole = {}
    for (doc, k), got in sorted(pieces.items()):
        whole.setdefault(doc, []).extend(got[0])
    assert {d: b"".join(back[i] for i in ids[:-1]).decode() for d, ids in whole.items()} == docs
    assert len(rows) <= sum(len(x) for x in whole.values()) / packing.LENGTH * 1.05 + 2


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), {b"a": 0}, 1).count() == 0
