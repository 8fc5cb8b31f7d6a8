"""Operator 8: n-gram Jaccard self-join with Bayesian candidate pruning.

Links are pairs of documents whose sets of five-word windows have a Jaccard
similarity of 0.8 or more (words are split at white space; a text of one to
four words has one window).

1. Documents with equal sets form a class (a 128-bit digest of the sorted set;
   its two halves are checked against each other, another salt follows if two
   sets share a half).  Only one document of a class goes on.
2. 240 MinHash values in 40 bands of 6: a pair of similarity 0.8 meets in no
   band with probability 5e-6.  Every class is joined to the least class of
   each of its bands (a line of edges for a bucket, never its pairs), and the
   components of these edges are the candidate groups.
3. A candidate group is split by hash into blocks of about BLOCK classes or
   BLOCK_WINDOWS windows, and every pair of blocks is one bounded task.  A
   component of more than CHAIN classes (weak links chain) is no candidate group:
   there each bucket of a band is one, and a pair counts in its first common band
   alone, so the work follows the pairs that meet, not the component's square.
   Inside a task, MinHash values are compared 16 at a time; a pair goes once the posterior probability (uniform
   prior) that its similarity reaches the threshold falls below TOLERANCE.  The
   rest is verified exactly on the windows.  A task returns a row for each
   linked class: its number of links and its part of a spanning forest.
4. The components of the forests are the final classes.

Defined results: each row gets class_id (the least doc_id of its class) and
n_links (other documents linked to it); texts without a word (null too) are
classes of their own with 0 links; repeated rows are documents; other columns
are ignored.  Hot keys (a class, bucket, node or repeated row with more than one
in HOT_KEYS of all rows) meet their facts by broadcast, never in one task.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import textnum as X
from .graph import components
from .spark_util import HOT_KEYS, arrow_map, cut, fresh, skew_join, table

K, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
STEP, TOLERANCE = 16, 1e-6
BLOCK, BLOCK_WINDOWS = 512, 1 << 22
CHAIN = BLOCK * BANDS  # from there on a text goes to fewer tasks by its bands than by pairs of blocks
_HASHES = BANDS * ROWS
_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 1 << 32, (_HASHES, 1), np.uint32)
_MUL = _rng.integers(0, 1 << 32, (_HASHES, 1), np.uint32) | np.uint32(1)
_BAND = _rng.integers(1, 1 << 62, (BANDS, ROWS)).astype(X.U64) | X.U64(1)


def window_sets(column, k: int = K):
    """The sorted distinct window hashes of each text."""
    for _, _, data, off in X.chunks(column, 1 << 18):
        h, first = X.word_hashes(data, off)
        h, _, start = X.shingles(h, first, k, whole=True)
        for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
            s = np.sort(h[a:b])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def minhash(windows: np.ndarray) -> np.ndarray:
    x = (windows >> X.U64(32)).astype(np.uint32)
    out = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        h = x[lo : lo + 1024] ^ _XOR
        h *= _MUL
        np.minimum(out, h.min(axis=1), out=out)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... compared values the least number of equal ones with which
    the similarity still reaches the threshold with probability tolerance: with
    a uniform prior that probability is P(Bin(n + 1, threshold) <= matches)."""
    out = []
    for n in range(STEP, _HASHES + 1, STEP):
        p, m = 0.0, 0
        while True:
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def band_values(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band, of one signature or a row of each."""
    parts = sig.reshape(*sig.shape[:-1], BANDS, ROWS).astype(X.U64)
    return X.mix64((parts * _BAND).sum(axis=-1, dtype=X.U64) + np.arange(BANDS, dtype=X.U64)).view(np.int64)


def _sketch(salt: bytes, k: int):
    names = ["key", "t", "node", "check", "bands", "size"]

    def run(batches):
        for batch in batches:
            node, check, bands, size = [], [], [], []
            for s in window_sets(batch.column(2), k):
                size.append(len(s))
                if not len(s):
                    node.append(None)
                    check.append(None)
                    bands.append(None)
                    continue
                d = hashlib.md5(salt + s.tobytes()).digest()
                node.append(int.from_bytes(d[:8], "little", signed=True))
                check.append(int.from_bytes(d[8:], "little", signed=True))
                bands.append(band_values(minhash(s)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(size, pa.int64())], names)

    return run


def links_between(sets: list[np.ndarray], side: np.ndarray, threshold: float = THRESHOLD, band: int = -1):
    """Index pairs (i < j) of similarity threshold or more; side: 0 and 1 for
    the two blocks of which only pairs across count, or all 2 for one block;
    band: only pairs that meet there and in no band before count."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    sig = np.stack([minhash(s) for s in sets])
    if n and side[0] == 2:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[near], j[near]
    if band >= 0:
        values, first = band_values(sig[:, : BANDS * ROWS]), np.zeros(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            met = values[i[lo : lo + (1 << 16)]] == values[j[lo : lo + (1 << 16)]]
            first[lo : lo + (1 << 16)] = met[:, band] & ~met[:, :band].any(axis=1)
        i, j = i[first], j[first]
    same = np.zeros(len(i), np.int32)
    for step, need in enumerate(least_matches(threshold)):
        if not len(i):
            break
        at = slice(step * STEP, (step + 1) * STEP)
        part = np.ascontiguousarray(sig[:, at])
        for lo in range(0, len(i), 1 << 16):
            hi = lo + (1 << 16)
            same[lo:hi] += (part[i[lo:hi]] == part[j[lo:hi]]).sum(axis=1, dtype=np.int32)
        keep = same >= need
        i, j, same = i[keep], j[keep], same[keep]
    if not len(i):
        return i, j
    used = np.union1d(i, j)
    flat = np.concatenate([sets[u] for u in used])
    _, ids = np.unique(flat, return_inverse=True)
    start = dict(zip(used.tolist(), np.concatenate([[0], np.cumsum(size[used])[:-1]]).tolist()))
    flag = np.zeros(len(flat) + 1, np.int32)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    common = np.zeros(len(i), np.int64)
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])), [len(i)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = ids[start[int(i[a])] : start[int(i[a])] + size[i[a]]]
        flag[own] = 1
        for q in range(a, b):
            s = start[int(j[q])]
            common[q] = flag[ids[s : s + size[j[q]]]].sum()
        flag[own] = 0
    good = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return i[good], j[good]


def _link_rows(k: int, threshold: float):
    """Rows (root, band, lo, hi, own, node, copies, text), sorted by the first
    four, to (node, to, links) for each linked node of a pair of blocks."""

    def solve(group: dict[int, tuple[int, int, str]], band: int):
        nodes = sorted(group)
        own = np.array([group[x][0] for x in nodes])
        copies = np.array([group[x][1] for x in nodes], np.int64)
        sets = list(window_sets(pa.array([group[x][2] for x in nodes], pa.large_string()), k))
        i, j = links_between(sets, own, threshold, band)
        links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        top = list(range(len(nodes)))

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
        hit = np.flatnonzero(links)
        return [nodes[x] for x in hit.tolist()], [nodes[find(x)] for x in hit.tolist()], links[hit].astype(np.int64).tolist()

    def run(batches):
        at, group = None, {}
        out: list[list[int]] = [[], [], []]

        def flush():
            if len(group) > 1:
                for all_, new in zip(out, solve(group, at[1])):
                    all_ += new

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for root, band, lo, hi, own, node, copies, text in zip(*cols):
                if (root, band, lo, hi) != at:
                    flush()
                    at, group = (root, band, lo, hi), {}
                group[node] = (2 if lo == hi else int(own == hi), copies, text)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "to", "links"])
                out = [[], [], []]
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "to", "links"])

    return run


NO_ID = 2**63 - 1  # sorts a null doc_id last of a class; a column tells it from a real id


def _key() -> tuple[Column, Column]:
    """An id (null: NO_ID) and a hash of the text, in which the lowest bit tells
    a null id from a real one."""
    doc_id = F.col("doc_id").cast("long")
    t = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(-2)).bitwiseOR(doc_id.isNull().cast("long"))
    return F.coalesce(doc_id, F.lit(NO_ID)), t


def _tasks(members: DataFrame, group: list[str], total: int) -> DataFrame:
    """members in pairs of blocks (lo, hi; own: the row's block) of their group,
    before they meet their texts."""
    sizes = members.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_WINDOWS)).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    met = skew_join(members, sizes, group, "n", total)
    return met.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))


def join(df: DataFrame, k: int = K, threshold: float = THRESHOLD, salt: int = 0) -> DataFrame:
    """(key, t, class_key, class_t, n_links) for each row of df (doc_id, text):
    key and t as of _key, the class has the key and t of its least document."""
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(_key()[0].alias("key"), _key()[1].alias("t"), F.col("text").cast("string").alias("text"))
    own = cut(arrow_map(docs, _sketch(salt.to_bytes(4, "little") if salt else b"", k), "key long, t long, node long, check long, bands array<long>, size long"))
    total = own.count()
    reps = cut(own.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min(F.struct("key", "t")).alias("low"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    if reps.where("c0 != c1").limit(1).count():
        return join(df, k, threshold, salt + 1)
    bands = reps.select("node", F.explode("bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    near = skew_join(bands, cut(least), ["band"], "n", BANDS * total).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = components(near)
    sizes = cut(groups.groupBy("root").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > CHAIN)
    large = F.broadcast(large.select("root")) if large.count() <= HOT_KEYS else large.select("root")
    members = cut(groups.join(reps.select("node", "copies", "size", "low.key", "low.t", "bands"), "node"))
    small = _tasks(members.join(large, "root", "left_anti").select("root", F.lit(-1).alias("band"), "node", "copies", "size", "key", "t"), ["root", "band"], total)
    chains = members.join(large, "root", "left_semi").select(F.posexplode("bands").alias("band", "bucket"), "node", "copies", "size", "key", "t")
    chained = _tasks(chains.select(F.col("bucket").alias("root"), "band", "node", "copies", "size", "key", "t"), ["root", "band"], BANDS * total)
    # texts: one for each representative, however often its row is repeated
    often = own.groupBy("key", "t").agg(F.count("*").alias("n")).where(F.col("n") > total / HOT_KEYS).where("n > 1").select("key", "t")
    hot = F.broadcast(often)  # HOT_KEYS rows at most
    texts = docs.join(hot, ["key", "t"], "left_anti").unionByName(docs.join(hot, ["key", "t"], "left_semi").groupBy("key", "t").agg(F.max("text").alias("text")))
    found = small.unionByName(chained).join(texts, ["key", "t"])
    pairs = found.select("root", "band", "own", "node", "copies", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("root", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "copies", "text")
    keys = ["root", "band", "lo", "hi"]
    links = cut(arrow_map(pairs.repartition(n_parts, *keys).sortWithinPartitions(*keys), _link_rows(k, threshold), "node long, to long, links long"))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    info = cut(reps.select("node", "copies", "low").join(final, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node")))
    classes = info.groupBy("root").agg(F.min("low").alias("of"), F.count("*").alias("n"))
    info = skew_join(info, classes, ["root"], "n", total).select("node", "of", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = skew_join(own.select("key", "t", "node"), cut(info), ["node"], "copies", total, "left")
    alone = F.col("node").isNull()
    return out.select("key", "t", F.when(alone, F.col("key")).otherwise(F.col("of.key")).alias("class_key"), F.when(alone, F.col("t")).otherwise(F.col("of.t")).alias("class_t"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(df: DataFrame) -> DataFrame:
    """The rows of df (all columns) without near duplicates: of each class the
    least (doc_id, text hash) stays, once where its row is repeated."""
    classes = cut(join(df))
    key, t, gone, n = (fresh(df, c) for c in ("key", "t", "gone", "n"))
    verdict = cut(classes.groupBy("key", "t").agg(F.max((F.col("key") != F.col("class_key")) | (F.col("t") != F.col("class_t"))).alias(gone), F.max("n_links").alias("links"), F.count("*").alias(n)))
    total, repeated = verdict.agg(F.sum(n), F.max((F.col("links") > 0) & (F.col(n) > 1))).first()
    keyed = df.withColumns(dict(zip((key, t), _key())))
    kept = skew_join(keyed, verdict.select(F.col("key").alias(key), F.col("t").alias(t), gone, n), [key, t], n, total or 0).where(~F.col(gone))
    return (kept.dropDuplicates([key, t]) if repeated else kept).select(df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = join(table(spark, sf_dir, "documents"))
    real = lambda c, t: F.when(F.col(t).bitwiseAND(F.lit(1)) == 0, F.col(c))
    return done.select(real("key", "t").alias("doc_id"), real("class_key", "class_t").alias("class_id"), "n_links")


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= {K} THEN list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rid != b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE common >= {THRESHOLD} * (a.n + b.n - common) - 1e-9),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, k.class_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_links
FROM d JOIN (SELECT r.x, min(e.doc_id) AS class_id FROM r JOIN d e ON e.rid = r.y GROUP BY 1) k ON k.x = d.rid
LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) m ON m.x = d.rid
"""
