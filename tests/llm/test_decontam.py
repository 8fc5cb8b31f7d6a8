import random

import numpy as np
import pyarrow as pa

from quernstone.llm import decontam as D
from quernstone.llm import textnum as X


def plain_score(text, item):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if item[i - 1] == text[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


def test_align():
    rnd = random.Random(5)
    for _ in range(300):
        text = np.array([rnd.randrange(5) for _ in range(rnd.randrange(0, 30))], X.U64)
        item = np.array([rnd.randrange(5) for _ in range(rnd.randrange(1, 12))], X.U64)
        score, a, b = D.align(text, item)
        assert score == plain_score(text, item)
        if score:
            assert plain_score(text[a:b], item) == score


def corpus():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7)))
    items = [" ".join(word() for _ in range(rnd.randrange(20, 40))) for _ in range(15)]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rnd.randrange(5, 200))]
        if d % 4 == 0:
            w = items[d % 15].split()
            if d % 8 == 0:
                w = [x for x in (x if rnd.random() > 0.15 else rnd.choice(["zz", ""]) for x in w) if x]
            at = rnd.randrange(len(body))
            body[at:at] = [x.upper() + "," for x in w]
        docs.append((d, " ".join(body)))
    return items, docs


def test_against_all_alignments(spark):
    items, docs = corpus()
    extra = [(1000, None), (1001, ""), (1002, "word " * 30000), (None, items[3]), (1003, items[3]), (1003, items[3])]
    df = spark.createDataFrame([(*x, "clash") for x in docs + extra], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.text): sorted(x.item_id for x in r.leaks) for r in D.find_leaks(df, bench).collect()}
    parts = {(r.doc_id, r.text): sorted(x.item_id for x in r.leaks) for r in D.find_leaks(df, bench, broadcast_bytes=2000).collect()}
    words = lambda t: next(D.item_words(pa.array([t], pa.large_string())))[2]
    for d, t in docs:
        want = [i for i, item in enumerate(items) if D.align(words(t), words(item))[0] >= D.MIN_SCORE * D.MATCH * len(words(item))]
        assert got[(d, t)] == want == parts[(d, t)]
    assert got[(None, items[3])] == got[(1003, items[3])] == [3]
    assert not got[(1000, None)] and not got[(1001, "")] and not got[(1002, "word " * 30000)]


def test_query(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = D.query(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert {i for i, t in items.items() if t in docs[r.doc_id]} <= set(r.item_ids)
        assert r.contaminated == bool(r.item_ids)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in D.find_leaks(df, none).collect()] == [[]]
    assert D.find_leaks(df.limit(0), none).count() == 0


def test_bound():
    rnd = random.Random(6)
    for _ in range(300):
        text = np.array([rnd.randrange(8) for _ in range(rnd.randrange(1, 30))], X.U64)
        item = np.array([rnd.randrange(5) for _ in range(rnd.randrange(1, 12))], X.U64)
        assert D.align(text, item)[0] <= D.bound(text, item)


def test_many_copies_of_an_edited_passage(spark):
    """Edits of all copies destroy seeds, and what is left of them is frequent."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    edited = [word() if i in (6, 14, 22, 30) else w for i, w in enumerate(item)]
    docs = [(d, " ".join([word() for _ in range(20)] + edited + [word() for _ in range(20)])) for d in range(D.MAX_DF + 10)]
    common = [(1000 + d, " ".join(item[:4] + [word() for _ in range(60)])) for d in range(D.MAX_DF + 10)]
    df = spark.createDataFrame(docs + common, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in D.find_leaks(df, bench).collect()}
    assert got == {**{d: [1] for d, _ in docs}, **{d: [] for d, _ in common}}


def test_parts_ties_and_clashing_names(spark):
    """Items in parts of one each give what one part gives; of two stretches of
    equal score the first is told; a column named like a part stays."""
    item = " ".join(f"w{i}" for i in range(12))
    other = " ".join(f"v{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, other), (3, item)], "item_id long, text string")
    gap = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{gap} {item} {gap} {item}", "k"), (2, f"{other} {item}", "k"), (3, gap, "k"), (4, None, "k")], "doc_id long, text string, leaks_0 string")
    shape = lambda df: {r.doc_id: sorted((x.item_id, x.score, x.start_word, x.end_word) for x in r.leaks) for r in df.collect()}
    whole, parts = D.find_leaks(docs, bench), D.find_leaks(docs, bench, broadcast_bytes=100)
    assert parts.columns == ["doc_id", "text", "leaks_0", "leaks"] and {r.leaks_0 for r in parts.collect()} == {"k"}
    assert shape(whole) == shape(parts)
    assert shape(whole)[1] == [(1, 1.0, 60, 72), (3, 1.0, 60, 72)] and [x[0] for x in shape(whole)[2]] == [1, 2, 3] and shape(whole)[3] == []
