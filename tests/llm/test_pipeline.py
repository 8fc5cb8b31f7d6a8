import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from quernstone.llm import bpe, decontam, jaccard, langid
from quernstone.llm import textnum as X


def by_hand(spark, sf):
    docs = sorted((r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    model = langid.fit_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = []
    for i, t, _ in docs:
        p, letter = next((langid.scores(model, d, o)) for _, _, d, o in X.chunks(pa.array([t], pa.large_string())))
        if letter[0] and p[0].max() >= model.least:
            kept.append((i, t))
    seen, out = set(), []
    for i, t in kept:  # in order of doc_id
        ls = t.split("\n")
        full = [k for k, x in enumerate(ls) if x.split()]
        size = {k: len(ls[k].encode().split()) for k in full}
        pairs = [((ls[a], ls[b]), (a, b)) for a, b in zip(full, full[1:])] + [((ls[a],), (a,)) for a in full if size[a] >= 50]
        hit = set()
        for window, places in pairs:
            hit |= set(places) if window in seen else set()
            seen.add(window)
        gone, run = set(), []
        for k in [*full, None]:
            if k in hit:
                run.append(k)
            else:
                if sum(size[x] for x in run) >= 50:
                    gone |= set(range(run[0], run[-1] + 1))
                run = []
        text = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        if not gone or text.split():
            out.append((i, text))
    def windows(t):
        w = t.encode().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = [windows(t) for _, t in out]
    top = list(range(len(out)))
    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(out)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    out = [d for k, d in enumerate(out) if find(k) == k]
    words = lambda t: next(decontam.item_words(pa.array([t], pa.large_string())), (0, 0, np.zeros(0, X.U64)))[2]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = [(i, t) for i, t in out if not any(decontam.align(words(t), w)[0] >= decontam.MIN_SCORE * decontam.MATCH * len(w) for w in items)]
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.default_ranks(), special_tokens={})
    ids = {i: known.encode_ordinary(t) for i, t in out}
    return sorted((i, len(ids[i]), hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in out)


def test_pipeline(spark, sf):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == by_hand(spark, sf)


def test_stages_keep_columns(spark):
    rows = [(1, None, "en", None, None), (None, "", None, "s", 0), (2, "the one and the other " * 20, "en", "s", 5), (2, "the one and the other " * 20, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", jaccard.F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, "/root/testdata/sf0.001")
        assert done.columns == docs.columns
        done.collect()


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, clashing names, a very long text, repeated rows."""
    names = "doc_id long, text string, lang string, source string, n_chars long, key string, t string, gone string, node string, leaks string, __key string, block string, pieces string"
    long = " ".join(f"the word and of it{i % 977}" for i in range(200_000))
    rows = [(i, t, "en", "s", 1, *["x"] * 8) for i, t in [(1, long), (2, "the cat and the dog were here again today"), (2, "the cat and the dog were here again today"), (3, None)]]
    for data in (rows, []):
        docs = spark.createDataFrame(data, names)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, docs, "/root/testdata/sf0.001")
            assert done.columns == docs.columns and done.count() <= len(data)
    folder = str(tmp_path)
    spark.createDataFrame([], names).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
