"""Operator 4: toxic spans by a linear-chain conditional random field.

Tokens are runs of letters.  Token labels come from document labels: toxic is
a token with one of the few features (whole word, or word beginning) that
cover the toxic training documents and that others hardly have, chosen greedily
by support.  On these a two-state linear-chain CRF is trained by maximum
likelihood (hashed features, Adagrad on exact forward-backward gradients);
after that, tokens of toxic documents are labelled anew by its marginals and
it is trained once more.  Scoring runs forward-backward over every token of
every whole text; a document's marginals aggregate to a logistic score, its
likely tokens to spans (start, end in code points, probability).

The recursions work on the ratio of the two states' messages, and in blocks:
2 x 2 matrices over all blocks at once, then one short scan over the blocks,
so nothing loops over tokens in Python.

Training uses at most about max_docs labelled documents (least id hashes) of
max_bytes of text together.
Defined results: null and empty texts get the score of a document without
toxic tokens; repeated rows get equal scores; labels given twice count as
toxic if one says so; without labels of both kinds all scores are the share of
toxic ones (0 without any); other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnum as X
from .spark_util import bounded_sample, extend, held_out, sample_rows, table

BITS = 18
MAX_DOCS = 6000  # labelled documents that the model is fitted on, at most about so many
MAX_BYTES = 64 << 20  # of their texts
BLOCK = 128
CHUNK = 1 << 18


@dataclass
class Model:
    weights: np.ndarray | None  # 2**BITS state weights
    trans: np.ndarray  # 2 x 2 log potentials
    start: float  # log odds of toxic at a text's first token
    head: np.ndarray  # logistic weights of the document's aggregates
    base: float


def tokens(data: np.ndarray, off: np.ndarray):
    """Starts, ends (bytes), each row's first token, and bucket numbers of each
    token's features: word; beginnings of 3, 4, 5 bytes; ending of 3 bytes."""
    buf = X.folded(data)
    s, e, first = X.words(buf, off)
    n = len(s)
    feats = np.empty((5, n), np.intp)
    for k, (a, b) in enumerate(((s, e), (s, np.minimum(s + 3, e)), (s, np.minimum(s + 4, e)), (s, np.minimum(s + 5, e)), (np.maximum(e - 3, s), e))):
        feats[k] = X.mix64(X.span_hashes(buf, a, b) + X.U64(k + 1)) >> X.U64(64 - BITS)
    return s, e, first, feats


def ratios(gain: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """For each token the forward ratio r and the backward ratio b of toxic to
    other; its marginal is r b / (1 + r b).  gain: exp of the state scores."""
    n = len(gain)
    if n == 0:
        return gain, gain
    (a00, a01), (a10, a11) = np.exp(trans)
    blocks = -(-n // BLOCK)
    size = blocks * BLOCK
    head = np.zeros(size, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    g = np.ones(size)
    g[:n] = gain
    head[n:] = True
    e0 = np.exp(start)
    shape = (blocks, BLOCK)
    g, head = np.ascontiguousarray(g.reshape(shape).T), np.ascontiguousarray(head.reshape(shape).T)
    # a step forward maps (1, r) by [[p00, p01 g], [p10, p11 g]]; at a text's head both rows are (1, e0)
    p00, p01 = np.where(head, 1.0, a00), np.where(head, e0, a01) * g
    p10, p11 = np.where(head, 1.0, a10), np.where(head, e0, a11) * g

    def scan(steps, into):
        m00, m01, m10, m11 = (np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks))
        for t in steps:
            q00, q01, q10, q11 = into(t)
            m00, m01, m10, m11 = m00 * q00 + m01 * q10, m00 * q01 + m01 * q11, m10 * q00 + m11 * q10, m10 * q01 + m11 * q11
            norm = 1 / (m00 + m01 + m10 + m11)
            m00, m01, m10, m11 = m00 * norm, m01 * norm, m10 * norm, m11 * norm
        return m00.tolist(), m01.tolist(), m10.tolist(), m11.tolist()

    m = scan(range(BLOCK), lambda t: (p00[t], p01[t], p10[t], p11[t]))
    enter, x = np.empty(blocks), 1.0
    for k in range(blocks):
        enter[k] = x
        x = (m[1][k] + x * m[3][k]) / (m[0][k] + x * m[2][k])
    fwd, x = np.empty((BLOCK, blocks)), enter
    for t in range(BLOCK):
        x = (p01[t] + x * p11[t]) / (p00[t] + x * p10[t])
        fwd[t] = x
    # backward over the step from a token to the next: column vectors (1, b)
    flat = [np.append(q.T.ravel(), 1.0) for q in (p00, p01, p10, p11)]
    nxt = [np.ascontiguousarray(q[1:].reshape(shape).T) for q in flat]
    m = scan(range(BLOCK), lambda t: (nxt[0][t], nxt[1][t], nxt[2][t], nxt[3][t]))
    leave, x = np.empty(blocks), 1.0
    for k in range(blocks - 1, -1, -1):
        leave[k] = x
        x = (m[2][k] + m[3][k] * x) / (m[0][k] + m[1][k] * x)
    bwd, x = np.empty((BLOCK, blocks)), leave
    for t in range(BLOCK - 1, -1, -1):
        x = (nxt[2][t] + nxt[3][t] * x) / (nxt[0][t] + nxt[1][t] * x)
        bwd[t] = x
    return fwd.T.ravel()[:n], bwd.T.ravel()[:n]


def state_gain(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    z = weights.take(feats[0])
    for f in feats[1:]:
        z = z + weights.take(f)
    return np.exp(np.clip(z, -30, 30))


def marginals(model: Model, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
    r, b = ratios(state_gain(model.weights, feats), first, model.trans, model.start)
    x = r * b
    return x / (1 + x)


def aggregates(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row for each text: 1, log of 1 + expected toxic tokens, greatest
    marginal, expected toxic tokens up to 3, and these by the text's log length,
    as one likely token says less in a long text."""
    n = X.row_sums(np.where(p > 1e-4, p, 0), first)
    few = np.minimum(n, 3)
    return np.stack([np.ones(len(n)), np.log1p(n), X.row_max(p, first), few, few * np.log1p(np.diff(first))], 1)


def toxic_features(parts, toxic: np.ndarray) -> np.ndarray:
    """Buckets that mark toxic tokens: a greedy cover of the toxic documents by
    word and beginning features which hardly any other document has."""
    size = 1 << BITS
    df = np.zeros((2, size), np.int64)
    of_doc = []
    at = 0
    for _, first, feats in parts:
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        keys = np.unique(np.concatenate([(rows.astype(np.int64) << BITS) | feats[k] for k in (0, 1, 2, 3)]))
        doc, bucket = keys >> BITS, keys & (size - 1)
        y = toxic[at : at + len(first) - 1]
        for v in (0, 1):
            df[v] += np.bincount(bucket[y[doc] == v], minlength=size)
        hit = y[doc] == 1
        of_doc.append((doc[hit] + at, bucket[hit]))
        at += len(first) - 1
    bad, fine = int((toxic == 1).sum()), int((toxic == 0).sum())
    need = max(3, bad // 100)
    # rate among toxic documents against the rate among the others
    good = (df[1] >= need) & (df[1] / max(bad, 1) > 25 * (df[0] + 0.2) / max(fine, 1))
    doc = np.concatenate([d for d, _ in of_doc])
    bucket = np.concatenate([b for _, b in of_doc])
    keep = good[bucket]
    doc, bucket = doc[keep], bucket[keep]
    chosen = []
    while len(doc):
        count = np.bincount(bucket, minlength=size)
        top = int(count.argmax())
        if count[top] < need:
            break
        chosen.append(top)
        left = ~np.isin(doc, doc[bucket == top])
        doc, bucket = doc[left], bucket[left]
    # what comes with a chosen feature in other documents as well marks tokens too
    strong = np.flatnonzero((df[1] >= max(4, bad // 60)) & (df[0] / max(fine, 1) < 0.001 * df[1] / max(bad, 1)))
    return np.union1d(np.array(chosen, np.int64), strong)


def without_copies(texts: list[str]) -> np.ndarray:
    """Which texts to learn from: not those of which an earlier one has three
    or more of eight least hashes of 5-word windows, as copies would make any
    word of theirs look telling."""
    keep = np.ones(len(texts), bool)
    seen: dict[tuple[int, int], int] = {}
    at = 0
    for lo, hi, data, off in X.chunks(pa.array(texts, pa.large_string()), CHUNK):
        h, first = X.word_hashes(data, off)
        h, _, start = X.shingles(h, first, 5, whole=True)
        for r in range(hi - lo):
            own = h[start[r] : start[r + 1]]
            if len(own):
                keys = [(i, int(X.mix64(own ^ X.U64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min())) for i in range(8)]
                match = [seen[k] for k in keys if k in seen]
                if match and max(match.count(m) for m in set(match)) >= 3:
                    keep[at + r] = False
                else:
                    for k in keys:
                        seen.setdefault(k, at + r)
        at += hi - lo
    return keep


def train(parts, gold, model: Model, epochs: int, rate: float = 0.3) -> None:
    """Maximises the likelihood of the token labels gold (one array for each part)."""
    size = 1 << BITS
    grad2, trans2, start2 = np.ones(size), np.ones((2, 2)), 1.0
    for _ in range(epochs):
        for (_, first, feats), y in zip(parts, gold):
            n = len(y)
            if not n:
                continue
            gain = state_gain(model.weights, feats)
            r, b = ratios(gain, first, model.trans, model.start)
            p = r * b / (1 + r * b)
            diff = y - p
            g = np.zeros(size)
            for f in feats:
                g += np.bincount(f, diff, size)
            g -= 1e-3 * model.weights
            grad2 += g * g
            model.weights += rate * g / np.sqrt(grad2)
            head = np.zeros(n, bool)
            head[first[:-1][np.diff(first) > 0]] = True
            inner = np.flatnonzero(~head)
            if len(inner):
                a = np.exp(model.trans)
                gb = gain[inner] * b[inner]
                w = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] * gb, a[1, 0] * r[inner - 1], a[1, 1] * r[inner - 1] * gb])
                w /= w.sum(0)
                seen = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4)
                t = (seen - w.sum(1)).reshape(2, 2)
                trans2 += t * t
                model.trans = model.trans + 0.1 * t / np.sqrt(trans2)
            s = float(diff[head].sum())
            start2 += s * s
            model.start += 0.1 * s / np.sqrt(start2)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.01] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], epochs: int = 6) -> Model:
    y = np.array(labels, np.int64)
    base = float(y.mean()) if len(y) else 0.0
    model = Model(None, np.array([[0.0, -3.0], [0.0, -2.0]]), -3.0, np.zeros(5), base)
    if not len(y) or y.min() == y.max():
        return model
    rng = np.random.default_rng(5)
    fresh = np.flatnonzero(without_copies(texts))
    order = rng.permutation(fresh if y[fresh].min() != y[fresh].max() else len(y))
    texts, y = [texts[i] for i in order], y[order]
    parts, rows = [], []
    for lo, hi, data, off in X.chunks(pa.array(texts, pa.large_string()), CHUNK):
        _, _, first, feats = tokens(data, off)
        parts.append((off, first, feats))
        rows.append((lo, hi))
    marks = np.zeros(1 << BITS, bool)
    marks[toxic_features(parts, y)] = True
    gold = [((marks[feats[0]] | marks[feats[1]] | marks[feats[2]] | marks[feats[3]]) & np.repeat(y[lo:hi] == 1, np.diff(first))).astype(np.float64) for (lo, hi), (_, first, feats) in zip(rows, parts)]
    model.weights = np.zeros(1 << BITS)
    train(parts, gold, model, epochs)
    for k, ((lo, hi), (_, first, feats)) in enumerate(zip(rows, parts)):
        bad = np.repeat(y[lo:hi] == 1, np.diff(first))
        gold[k] = np.where(bad, np.maximum(gold[k], marginals(model, feats, first) > 0.9), 0.0)
    train(parts, gold, model, 2)
    x = np.concatenate([aggregates(marginals(model, feats, first), first) for _, first, feats in parts])
    model.head = logistic(x, y.astype(np.float64))
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """From the labelled documents that aren't held out."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = bounded_sample(known, "doc_id", max_docs)
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    one = text.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # a row for each id, however often it comes
    rows = sorted((r[0], r[1], r[2]) for r in sample_rows(one, "doc_id", "text", max_bytes))
    return fit([r[1] for r in rows], [int(r[2] == 1) for r in rows])


def score_texts(model: Model, column, with_spans: bool = True):
    """Score of each text, and its toxic spans (start, end, probability)."""
    scores, spans = [], []
    for _, _, data, off in X.chunks(column, CHUNK):
        rows = len(off) - 1
        found: list[list] = [[] for _ in range(rows)]
        if model.weights is None:
            scores.append(np.full(rows, model.base))
        else:
            s, e, first, feats = tokens(data, off)
            p = marginals(model, feats, first)
            scores.append(1 / (1 + np.exp(-np.clip(aggregates(p, first) @ model.head, -30, 30))))
            hot = np.flatnonzero(p >= 0.5) if with_spans else []
            if len(hot):
                place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                row = np.searchsorted(first, hot, "right") - 1
                for t, r in zip(hot.tolist(), row.tolist()):
                    a, b = int(place[s[t]] - place[off[r]]), int(place[e[t]] - place[off[r]])
                    found[r].append({"start": a, "end": b, "p": float(p[t])})
        spans += found
    return np.concatenate(scores) if scores else np.zeros(0), spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score double and spans: start and end in code points, probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS weights

    def run(column):
        score, spans = score_texts(shared.value, column)
        return pa.array(score, pa.float64()), pa.array(spans, SPANS)

    return extend(df, text_col, run, "score double, spans array<struct<start: bigint, end: bigint, p: double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs, table(spark, sf_dir, "labels"))
    done = predict(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
