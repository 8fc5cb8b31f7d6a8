import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import langid, toxicity
from quernstone.llm.spark_util import held_out


def test_held_out_accuracy_of_languages(spark):
    f = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{f}/documents.parquet").collect()}
    rows = langid.query(spark, f).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_of_languages(spark):
    train = [("the cat and the dog " * 3, "en"), ("le chat et la souris " * 3, "fr")] * 30
    model = langid.fit([t for t, _ in train], [x for _, x in train])
    odd = [(1, None, "x"), (2, "", "x"), (3, "123 *** \n", "x"), (4, "the " * 50000, "x"), (5, "le", "x"), (None, "le chat", "x"), (4, "the " * 50000, "x"), (7, "日本", "x")]
    df = langid.predict(spark.createDataFrame(odd, "doc_id long, text string, lang_pred string"), model)
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in df.collect()]
    assert sorted(map(str, got[:3])) == ["(1, 'und', True)", "(2, 'und', True)", "(3, 'und', True)"]
    assert {x for x in got if x[0] == 4} == {(4, "en", False)}
    assert df.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    none = langid.fit_documents(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.predict(df.select("doc_id", "text").limit(1), none).collect()] == ["und"]


def test_scores_against_plain_sums():
    """Averages over all n-grams of the whole text, by dictionaries of bytes."""
    model = langid.fit(["the cat and the dog was here", "le chat et la souris", "die katze und der hund"] * 20, ["en", "fr", "de"] * 20)
    for text in ["the cat", "Le chat, der HUND 12 x", "x", "the le " * 3000, "ÉTÉ über", "a b c"]:
        raw = b" " + langid.X.folded(np.frombuffer(text.encode(), np.uint8)).tobytes() + b" "
        total, n = np.zeros(3), 0
        for k in (2, 3, 4):
            for a in range(len(raw) - k + 1):
                g = raw[a : a + k]
                if b" " in g[1:-1] or not g.strip():
                    continue
                h = 0
                for c in g:
                    h = (h * 0x01000193 + c) % 2**32
                h = ((h ^ h >> 15) * 0x9E3779B1 % 2**32) >> (32 - langid.BITS)
                total, n = total + model.table[h, :3].astype(float), n + 1
        z = (total / max(n, 1) + model.bias) / model.temperature
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        got = next(langid.scores(model, d, o)[0][0] for _, _, d, o in langid.X.chunks(pa.array([text], pa.large_string())))
        assert np.allclose(got, want, atol=1e-5), text


def test_empty_tables_and_clashing_names(spark):
    model = langid.fit(["the cat and the dog", "le chat et la souris"] * 20, ["en", "fr"] * 20)
    none = spark.createDataFrame([], "doc_id long, text string, score string, spans int, rejected int")
    assert langid.predict(none, model).columns == ["doc_id", "text", "spans", "lang_pred", "score", "rejected"]
    assert langid.predict(none, model).count() == 0
    toxic = toxicity.fit(["fine words here", "filth and more filth"] * 20, [0, 1] * 20)
    assert toxicity.predict(none, toxic).columns == ["doc_id", "text", "rejected", "score", "spans"] and toxicity.predict(none, toxic).count() == 0
    clash = spark.createDataFrame([(1, "filth", "x")], "doc_id long, text string, score string")
    assert [0 < r.score < 1 for r in toxicity.predict(clash, toxic).collect()] == [True]


def test_document_score_by_plain_recursion():
    """The score of a text from marginals by loops and aggregates by hand."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("tun", "lor", "mek", "sif") for b in ("ing", "on", "er", "th")]
    labels = [int(i % 4 == 0) for i in range(200)]
    texts = [" ".join(rng.choice(words, 30)) + (" filth scum" * 2 if y else "") for y in labels]
    model = toxicity.fit(texts, labels)
    for text in ("", "tuning filth scum loron", "meker " * 300 + "filth", texts[0], texts[1]):
        data, off = langid.X.utf8(pa.array([text], pa.large_string()))
        _, _, first, feats = toxicity.tokens(data, off)
        gain = np.exp(model.weights[feats].sum(0)) if feats.shape[1] else np.zeros(0)
        p = by_loops(gain, first, model.trans, model.start)
        hits = sum(x for x in p if x > 1e-4)
        x = [1, np.log(1 + hits), max(p, default=0), min(hits, 3), min(hits, 3) * np.log(1 + len(text.split()))]
        want = 1 / (1 + np.exp(-np.clip(np.dot(x, model.head), -30, 30)))
        assert np.allclose(toxicity.score_texts(model, pa.array([text]))[0], want, atol=1e-6)


def test_scores_do_not_depend_on_the_batch():
    model = langid.fit(["the cat and the dog", "le chat et la souris"] * 20, ["en", "fr"] * 20)
    texts = ["the cat", "", "le chat\n", "x", "the le " * 100]
    def one(rows):
        column = pa.array(rows, pa.large_string())
        return np.concatenate([langid.scores(model, d, o)[0] for _, _, d, o in langid.X.chunks(column)])
    assert np.allclose(one(texts), np.concatenate([one([t]) for t in texts]), atol=1e-6)


def by_loops(gain, first, trans, start):
    a, out = np.exp(trans), np.zeros(len(gain))
    for lo, hi in zip(first[:-1], first[1:]):
        if lo == hi:
            continue
        f, b = np.zeros((hi - lo, 2)), np.ones((hi - lo, 2))
        f[0] = [1, np.exp(start) * gain[lo]]
        for t in range(1, hi - lo):
            f[t] = [f[t - 1] @ a[:, 0], f[t - 1] @ a[:, 1] * gain[lo + t]]
            f[t] /= f[t].sum()
        for t in range(hi - lo - 2, -1, -1):
            b[t] = a @ (np.array([1, gain[lo + t + 1]]) * b[t + 1])
            b[t] /= b[t].sum()
        out[lo:hi] = (f * b)[:, 1] / (f * b).sum(1)
    return out


@pytest.mark.parametrize("first", [[0, 3, 3, 10, 400, 401, 1000], [0, 1], [0, 0, 128, 256, 300], [0, 0]])
def test_marginals_against_plain_recursion(first):
    rng = np.random.default_rng(2)
    first = np.array(first)
    gain, trans, start = np.exp(2 * rng.normal(size=first[-1])), rng.normal(size=(2, 2)), 0.3
    r, b = toxicity.ratios(gain, first, trans, start)
    assert np.allclose(r * b / (1 + r * b), by_loops(gain, first, trans, start))


def test_toxic_documents(spark):
    rng = np.random.default_rng(1)
    plain = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(list("abcdef"), 60), rng.choice(["ing", "on", "er", "th"], 60))) for _ in range(400)]
    labels = [int(i % 5 == 0) for i in range(400)]
    texts = [t.replace(" ", " Scumbag! ", 3).replace("ing", "ing filth", 2) if y else t for t, y in zip(plain, labels)]
    model = toxicity.fit(texts[:300], labels[:300])
    score, spans = toxicity.score_texts(model, pa.array(texts[300:]))
    assert ((score >= 0.7) == np.array(labels[300:], bool)).mean() > 0.97
    i = labels[300:].index(1)
    assert "Scumbag" in {texts[300 + i][s["start"] : s["end"]] for s in spans[i]}
    odd = [(1, None), (2, ""), (3, "é Scumbag " * 30000), (4, "123"), (None, "é Scumbag filth"), (4, "123")]
    rows = toxicity.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert {r.score >= 0.7 for r in rows if r.doc_id in (1, 2, 4)} == {False}
    assert [s.start for s in next(r for r in rows if r.doc_id is None).spans][0] == 2
    assert len(next(r for r in rows if r.doc_id == 3).spans) == 30000


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit_documents(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in toxicity.predict(docs, model).collect()] == [0.0, 0.0]
    assert docs.select(held_out()).count() == 2


def test_toxicity_query(spark):
    f = "/root/testdata/sf0.01"
    rows = toxicity.query(spark, f).collect()
    assert len(rows) == spark.read.parquet(f"{f}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{f}/labels.parquet").collect()}
    pairs = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    yes, no = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert np.mean([a > b for a in yes for b in no]) > 0.85
    told = [y for s, y in pairs if s >= 0.7]
    assert sum(told) == len(told) >= 0.7 * len(yes)  # no clean document is told
