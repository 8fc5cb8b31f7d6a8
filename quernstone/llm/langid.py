"""Operator 6: language identification by averaged hashed subword embeddings.

Byte n-grams (2 to 4) inside blank-bounded words are hashed to embeddings,
averaged over the whole text and sent through a linear softmax, all trained by
stochastic gradient descent in numpy on a bounded sample (max_docs documents of
max_bytes together, those of the least id hashes): on the whole texts, and on
random stretches of them, so that short texts are known too.  A temperature fitted on a validation part
calibrates the probability; texts below a probability chosen there, null texts
and texts without a letter are rejected.

Since averaging and the linear layer commute, prediction adds up one row of
(embedding @ weights) for each n-gram: any text length, one vectorised pass.

Defined results: null, empty and letterless texts are `und` with score 0 and
rejected; repeated rows give equal rows; without a training row every text is
`und`; of languages of equal probability the first by name is told; other
columns stay, but for the ones of the result's names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnum as X
from .spark_util import bounded_sample, extend, held_out, sample_rows, table

BITS = 17
BUCKETS = 1 << BITS
MAX_DOCS = 4000  # documents that the model is fitted on, at most about so many
MAX_BYTES = 64 << 20  # of their texts


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1) x (languages, count of 1); the last row stands for no n-gram
    bias: np.ndarray
    temperature: float
    least: float  # calibrated probability below which a text is rejected


def grams(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers of the n-grams that start at each byte, for n of 2, 3 and
    4 (BUCKETS: none), over rows with a blank before and after, and each row's
    first place."""
    n, rows = len(data), len(off) - 1
    first = off + np.arange(rows + 1)
    text = np.ones(n + rows + 5, bool)
    text[first] = False
    text[n + rows + 1 :] = False
    buf = np.full(n + rows + 5, 32, np.uint8)
    buf[text] = X.folded(data)
    size = n + rows
    blank = buf == 32
    b = buf.astype(np.uint32)
    one, two = blank[1 : size + 1], blank[2 : size + 2]
    out = []
    h = b[:size]
    for k, bad in ((2, blank[:size] & one), (3, one), (4, one | two)):
        h = h * np.uint32(0x01000193)
        h += b[k - 1 : size + k - 1]
        g = h ^ (h >> np.uint32(15))
        g *= np.uint32(0x9E3779B1)
        g >>= np.uint32(32 - BITS)
        np.copyto(g, np.uint32(BUCKETS), where=bad)
        out.append(g.astype(np.intp))
    return out, first


def fit(texts: list[str], langs: list[str], dim: int = 8, epochs: int = 4, rate: float = 2.0, seed: int = 7) -> Model:
    """Learns from whole texts and from random stretches of them."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if not names:
        return Model([], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(0), 1.0, 1.0)
    number = {x: i for i, x in enumerate(names)}
    samples, labels, held = [], [], []
    valid = rng.random(len(texts)) < 0.2
    if valid.all() or not valid.any():
        valid[:] = np.arange(len(texts)) % 5 == 4
    for i, (t, lang) in enumerate(zip(texts, langs)):
        raw = t.encode()
        for size in (15, 40, 120, 500, len(raw)):
            a = int(rng.integers(0, max(1, len(raw) - size)))
            data = np.frombuffer(raw[a : a + size], np.uint8)
            g, _ = grams(data, np.array([0, len(data)]))
            count = np.unique(np.concatenate(g).astype(np.uint32), return_counts=True)
            known = count[0] < BUCKETS
            if known.any():
                samples.append((count[0][known], count[1][known].astype(np.float32)))
                labels.append(number[lang])
                held.append(valid[i])
    labels, held = np.array(labels, np.int64), np.array(held, bool)
    k = len(names)
    if not len(labels):
        return Model([], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(0), 1.0, 1.0)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w, bias = rng.normal(0, 0.5, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(labels))
    weight = len(train) / (k * np.maximum(np.bincount(labels[train], minlength=k), 1))
    batch, step, steps = 64, 0, epochs * -(-len(train) // 64)
    for _ in range(epochs):
        order = rng.permutation(train)
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            size = np.array([len(samples[i][0]) for i in pick])
            idx, seg = np.concatenate([samples[i][0] for i in pick]), np.repeat(np.arange(len(pick)), size)
            share = np.concatenate([samples[i][1] / samples[i][1].sum() for i in pick])[:, None]
            x = np.add.reduceat(emb[idx] * share, np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
            z = x @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= (weight[labels[pick]] / len(pick))[:, None]
            lr = rate * (1 - step / steps)
            dx = (p @ w.T).astype(np.float32) * np.float32(len(pick))
            w -= lr * (x.T @ p).astype(np.float32)
            bias -= lr * p.sum(0).astype(np.float32)
            np.add.at(emb, idx, (-lr * dx).astype(np.float32)[seg] * share)
            step += 1
    tab = np.zeros((BUCKETS + 1, k + 1), np.float32)
    tab[:-1, :-1], tab[:-1, -1] = emb @ w, 1
    check = np.flatnonzero(held) if held.any() else train
    z = np.array([np.average(tab[samples[i][0], :-1], axis=0, weights=samples[i][1]) + bias for i in check], np.float64)
    best, heat = np.inf, 1.0
    for t in np.geomspace(0.1, 10, 41):
        y = z / t
        m = y.max(1)
        nll = float((m + np.log(np.exp(y - m[:, None]).sum(1)) - y[np.arange(len(check)), labels[check]]).mean())
        if nll < best:
            best, heat = nll, float(t)
    y = z / heat
    p = np.exp(y - y.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top, right = p.max(1), p.argmax(1) == labels[check]
    # the least probability from which on 99 of 100 are right, but never above an even chance
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) >= 0.99 * np.arange(1, len(order) + 1))
    least = float(top[order[good[-1]]]) if len(good) else 1.0
    return Model(names, tab, bias.astype(np.float64), heat, min(least, 0.5))


def fit_documents(df: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_bytes: int = MAX_BYTES) -> Model:
    """From text and non-null lang of the rows that aren't held out."""
    known = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    some = bounded_sample(known.select(id_col, text_col, lang_col), id_col, max_docs)
    one = some.groupBy(id_col).agg(F.min(F.struct(text_col, lang_col)).alias("s"))  # a row for each id, however often it comes
    one = one.select(id_col, F.col(f"s.{text_col}").alias("text"), F.col(f"s.{lang_col}").alias("lang"))
    rows = sorted((r[0], r[1], r[2]) for r in sample_rows(one, id_col, "text", max_bytes))
    return fit([r[1] for r in rows], [r[2] for r in rows])


def scores(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities of each row's languages, and if it has a letter."""
    g, first = grams(data, off)
    rows = len(off) - 1
    total = np.zeros((rows, len(model.langs) + 1), np.float64)
    if len(g[0]):
        v = model.table.take(g[0], axis=0)
        v += model.table.take(g[1], axis=0)
        v += model.table.take(g[2], axis=0)
        ones = np.ones(int(np.diff(first).max()), np.float32)
        for r, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            total[r] = ones[: hi - lo] @ v[lo:hi]
    z = (total[:, :-1] / np.maximum(total[:, -1:], 1) + model.bias) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True)) if len(model.langs) else z
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    letter = X.row_any(ascii_letter, off)
    for r in np.flatnonzero(~letter & (np.diff(off) > 0)):
        letter[r] = any(c.isalpha() for c in data[off[r] : off[r + 1]].tobytes().decode())
    return p, letter


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred string, score double and rejected boolean."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS rows

    def run(column):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        lang, score, no = [], [], []
        for _, _, data, off in X.chunks(column, 1 << 17):
            p, letter = scores(m, data, off)
            fine = letter & (len(m.langs) > 0)
            top = p.max(1) if len(m.langs) else np.zeros(len(letter))
            lang.append(names[np.where(fine, p.argmax(1) if len(m.langs) else 0, len(m.langs))])
            score.append(np.where(fine, top, 0.0))
            no.append(~fine | (top < m.least))
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return cat(lang, pa.string()), cat(score, pa.float64()), cat(no, pa.bool_())

    return extend(df, text_col, run, "lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
