"""Operator 2: benchmark decontamination by rare n-gram seeds and Smith-Waterman
alignment.

Seeds are the SEED-word windows of the test items (words are runs of letters
and digits, lower case).  One pass over the documents finds those that hold
seeds; the documents of each seed are counted over the whole corpus.  A seed is
rare if it is among the RARE rarest of its item that occur at all, or if MAX_DF
documents at most have it.  Where MIN_SEEDS seeds of an item, of any frequency,
lie in a document, the surrounding stretch is aligned with the item word by word
(match 2, mismatch -1, gap -1); the best local score over the greatest possible
one (2 for each word of the item) is the similarity, and MIN_SCORE of it makes a
leak.  Edited copies keep some seeds and lose little score; foreign words between
are gaps.  Without MIN_SEEDS rare seeds a stretch is aligned only if an upper
bound of its score allows a leak, which loses none: rarity decides the work, not
the result.

The items are a stated query set: their seed table goes to every task if its
size, measured first, is below BROADCAST_BYTES, else in parts of that size,
one pass each.  Candidate documents stay where they are read; only seed counts
are shuffled.  Alignment is linear in the stretch and done by whole rows of
the matrix.

Defined results: null or empty texts have no leak; items with fewer words than
a seed are matched by all their words as one seed; null items are none;
repeated rows are documents; of alignments of equal score the first in the text
is told; other columns stay, but for one named leaks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnum as X
from .spark_util import arrow_map, extend, fresh, table

SEED = 3
RARE, MAX_DF = 8, 50
MIN_SCORE = 0.4
MIN_SEEDS = 2  # of one item in a document, or all of an item that has fewer
MATCH, MISMATCH, GAP = 2, -1, -1
BROADCAST_BYTES = 64 << 20

_FOLD = X._FOLD.copy()
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)


def item_words(column):
    """(word hashes of all rows, first word of each row) of lower-cased words."""
    for lo, hi, data, off in X.chunks(column, 1 << 18):
        buf = X.folded(data)
        digit = (data >= 48) & (data <= 57)
        buf[digit] = data[digit]
        h, first = X.word_hashes(buf, off)
        yield lo, hi, h, first


class Items:
    """Test items by number, with the sorted table of their seeds."""

    def __init__(self, ids: list, texts: list[str], k: int = SEED):
        self.ids, self.words = [], []
        seeds, owner = [], []
        column = pa.array(texts, pa.large_string())
        for lo, hi, h, first in item_words(column):
            s, at, start = X.shingles(h, first, k, whole=True)
            for r in range(hi - lo):
                if first[r + 1] > first[r]:
                    self.ids.append(ids[lo + r])
                    self.words.append(h[first[r] : first[r + 1]])
                    own = np.unique(s[start[r] : start[r + 1]])
                    seeds.append(own)
                    owner.append(np.full(len(own), len(self.ids) - 1))
        seeds = np.concatenate(seeds) if seeds else np.zeros(0, X.U64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.k, self.owner = k, owner[order]
        self.seeds, self.first = np.unique(seeds[order], return_index=True)
        self.first = np.append(self.first, len(owner))
        self.count = np.bincount(owner, minlength=len(self.ids))
        self.maybe = np.zeros(1 << 20, bool)  # by the upper 20 bits
        self.maybe[(self.seeds >> X.U64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold seeds, and the numbers of those seeds."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = np.flatnonzero(self.maybe[(h >> X.U64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.seeds, h[hit]), len(self.seeds) - 1)
        real = self.seeds[at] == h[hit]
        return hit[real], at[real]

    def __sizeof__(self) -> int:
        return self.seeds.nbytes + self.owner.nbytes + self.first.nbytes + sum(w.nbytes + 150 for w in self.words)


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: (score, first, end) of the best local
    alignment's stretch in text.  One row of the matrix for each item word; a
    row's gaps along the text are a running maximum."""
    n = len(text)
    if not n:
        return 0, 0, 0
    ramp = np.arange(n + 1) * -GAP
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, at = 0, (0, 0)
    places = np.arange(n + 1)
    for w in item:
        diag = score[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        take = diag >= up
        h = np.concatenate([[0], np.maximum(np.where(take, diag, up), 0)])
        o = np.concatenate([[0], np.where(take, origin[:-1], origin[1:])])
        o = np.where(h > 0, o, places)
        # a gap along the text: h[j] = max over i <= j of h[i] + GAP * (j - i)
        lifted = h + ramp
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, places, 0))
        score, origin = run - ramp, o[source]
        k = int(score.argmax())
        if score[k] > best:
            best, at = int(score[k]), (int(origin[k]), k)
    return best, *at


def bound(text: np.ndarray, item: np.ndarray) -> int:
    """No local alignment scores more: a word of the text that the item has is a
    match at best, any other a mismatch or gap; and no word matches more often
    than both sides have it."""
    words, need = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    known = words[at] == text
    have = np.bincount(at[known], minlength=len(words))
    total = np.concatenate([[0], np.cumsum(np.where(known, MATCH, max(MISMATCH, GAP)))])
    return int(min((total - np.minimum.accumulate(total)).max(), MATCH * np.minimum(need, have).sum()))


def stretches(places: np.ndarray, length: int, n: int) -> list[tuple[int, int]]:
    """The parts of a text of n words around seeds that an alignment with an
    item of that length can reach, overlapping ones as one."""
    reach = 2 * length
    out: list[list[int]] = []
    for p in np.sort(places).tolist():
        a, b = max(0, p - reach), min(n, p + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))


def leaks_of(items: Items, rare: np.ndarray, column, min_score: float = MIN_SCORE) -> list[list[dict]]:
    """The leaks of each text; rare: pairs (seed, owner) that start an alignment unbounded."""
    out: list[list[dict]] = []
    for lo, hi, h, first in item_words(column):
        s, at, start = X.shingles(h, first, items.k, whole=True)
        hit, seed = items.find(s)
        found: list[list[dict]] = [[] for _ in range(hi - lo)]
        if len(hit):
            count = np.diff(items.first)[seed]
            pair = np.repeat(items.first[seed], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(at[hit], count)
            row = np.searchsorted(first, place, "right") - 1
            who = items.owner[pair]
            order = np.lexsort((place, who, row))
            row, who, place, few = row[order], who[order], place[order], rare[pair[order]]
            edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (who[1:] != who[:-1])])) if len(row) else []
            for a, b in zip(edge, [*edge[1:], len(row)]):
                r, i = int(row[a]), int(who[a])
                enough = min(MIN_SEEDS, items.count[i])
                if b - a < enough:
                    continue
                item, text = items.words[i], h[first[r] : first[r + 1]]
                sure, least, best = few[a:b].sum() >= enough, min_score * MATCH * len(item), (0, 0, 0)
                for x, y in stretches(place[a:b] - first[r], len(item), len(text)):
                    if not sure and bound(text[x:y], item) < least:
                        continue
                    sc, u, v = align(text[x:y], item)
                    if sc > best[0]:
                        best = (sc, x + u, x + v)
                if best[0] >= least:
                    found[r].append({"item_id": items.ids[i], "score": best[0] / (MATCH * len(item)), "start_word": best[1], "end_word": best[2]})
        out += found
    return out


def _count_seeds(shared):
    def run(batches):
        items, total = shared.value, None
        for batch in batches:
            for lo, hi, h, first in item_words(batch.column(0)):
                s, _, start = X.shingles(h, first, items.k, whole=True)
                hit, seed = items.find(s)
                row = np.searchsorted(start, hit, "right") - 1
                pair = np.unique(row * len(items.seeds) + seed)
                got = np.bincount(pair % len(items.seeds), minlength=len(items.seeds)) if len(items.seeds) else np.zeros(0, np.int64)
                total = got if total is None else total + got
        if total is not None:
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], ["seed", "docs"])

    return run


def rare_pairs(items: Items, df_of_seed: np.ndarray, rare: int = RARE, max_df: int = MAX_DF) -> np.ndarray:
    """Which (seed, item) pairs are rare: each item's rarest ones that occur and
    all that few documents have."""
    seed_of = np.repeat(np.arange(len(items.seeds)), np.diff(items.first))
    df = df_of_seed[seed_of]
    order = np.lexsort((seed_of, df, df == 0, items.owner))  # seeds of no document last
    rank = np.empty(len(order), np.int64)
    own = items.owner[order]
    begin = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    rank[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
    return (rank < rare) | (df <= max_df)


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with leaks: array of (item_id, score, start_word, end_word)."""
    spark = df.sparkSession
    real = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = real.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-12 * size // broadcast_bytes) or 1  # a seed and its owner take 16 bytes, a word 8, a word of text 5
    out = df.drop("leaks")
    names = []
    for p in range(parts):
        rows = sorted((r[0] is None, r[0] or 0, r[1]) for r in real.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect())
        items = Items([None if n else i for n, i, _ in rows], [t for _, _, t in rows])
        shared = spark.sparkContext.broadcast(items)  # about broadcast_bytes at most
        counts = arrow_map(df.select(F.col(text_col).cast("string")), _count_seeds(shared), "seed long, docs long").groupBy("seed").agg(F.sum("docs").alias("docs"))
        df_of_seed = np.zeros(len(items.seeds), np.int64)
        for r in counts.collect():  # one row for each seed of this part
            df_of_seed[r[0]] = r[1]
        rare = spark.sparkContext.broadcast(rare_pairs(items, df_of_seed))
        name = "leaks" if parts == 1 else fresh(out, f"leaks_{p}")

        def run(column, shared=shared, rare=rare):
            return (pa.array(leaks_of(shared.value, rare.value, column, min_score), LEAK),)

        out = extend(out, text_col, run, f"{name} array<struct<item_id: bigint, score: double, start_word: bigint, end_word: bigint>>")
        names.append(name)
    if parts > 1:
        out = out.withColumn("leaks", F.flatten(F.array(*names))).drop(*names)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("leaks", lambda x: x["item_id"]))
    return done.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_max(F.transform("leaks", lambda x: x["score"])).alias("best_score"), "leaks")
