"""Operator 3: quality rules with cross-document line frequency.

One vectorised pass takes each text's own measures and its distinct normalised
lines (words joined by one blank, lower case) as hashes.  The distinct
documents of each (host, line) are counted, lines in more than max_docs
documents of a host are removed, and a document that loses more than
max_removed of its words is rejected.  `source` is the host here.

No key is gathered: counts are summed before the shuffle, and very frequent
lines (and rows repeated very often) meet their counts by broadcast, with a
proven bound of such keys (skew_join).  clean() gives the texts of kept documents
without the removed lines.

Defined results: null text counts as none (0 words, base_failed); repeated
rows get equal verdicts and count as one document where the doc_id is equal;
null doc_id counts as one document; null hosts form one host; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import textnum as X
from .spark_util import arrow_map, cut, extend, fresh, skew_join, table

MAX_DOCS = 20  # documents of one host that may share a line
MAX_REMOVED = 0.8  # share of a document's words: of the labelled ones that lose a fifth to four fifths, 23 of 26 are good (sf0.1)
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h: bigint, n: bigint>>"
_LINES = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))


def measures(column):
    """The columns of MEASURES for an Arrow column of texts."""
    out: list[list] = [[] for _ in range(5)]
    lines_of = []
    for lo, hi, data, off in X.chunks(column, 1 << 18):
        starts, ends, first = X.words(data, off)
        lead = ((data & 0xC0) != 0x80).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(lead)])
        chars = np.concatenate([[0], np.cumsum(before[ends] - before[starts])])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        h, at, win = X.shingles(X.span_hashes(data, starts, ends), first, 5)
        row = np.repeat(np.arange(hi - lo, dtype=X.U64), np.diff(win))
        codes, _ = pd.factorize(h ^ X.mix64(row + X.U64(1)))
        twice = at[np.bincount(codes)[codes] > 1] if len(codes) else at
        step = np.bincount(twice, minlength=len(starts) + 6) - np.bincount(twice + 5, minlength=len(starts) + 6)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[: len(starts)] > 0)])
        for k, x in enumerate((first, chars[first], symbols[off], None, covered[first])):
            if x is not None:
                out[k].append(np.diff(x))
        raw = data.tobytes()
        dup = np.zeros(hi - lo, np.int64)
        for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            seen, found = set(), {}
            for line in raw[a:b].split(b"\n"):
                w = line.split()
                if w:
                    if line in seen:
                        dup[r] += 1
                    seen.add(line)
                    key = line_key(w)
                    found[key] = found.get(key, 0) + len(w)
            lines_of.append([{"h": k, "n": n} for k, n in found.items()])
        out[3].append(dup)
    return [*(pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out), pa.array(lines_of, _LINES)]


def _facts(df: DataFrame, host_col: str, max_docs: int) -> tuple[DataFrame, DataFrame, int]:
    """(each row's measures, (k1, k2, removed, gone: hashes of the lines over the
    limit, copies) of the documents with such lines, number of rows)."""
    docs = df.select("doc_id", F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns(dict(zip(("k1", "k2"), _key())))
    own = cut(extend(docs, "text", measures, MEASURES).drop("text"))
    lines = own.select("k1", "k2", "host", F.inline("lines"))
    often = _often(lines, max_docs)
    each = lines.groupBy("k1", "k2", "host", "h", "n").agg(F.count("*").alias("copies"))
    rows, total = own.agg(F.count("*"), F.sum(F.size("lines"))).first()
    met = skew_join(each, often, ["host", "h"], "docs", total or 0)
    return own, cut(met.groupBy("k1", "k2").agg(F.sum("n").alias("removed"), F.collect_set("h").alias("gone"), F.max("copies").alias("copies"))), rows


def _key() -> tuple[Column, Column]:
    """A row's id (null: 0) and the hash of its text, whose lowest bit tells a null id."""
    doc_id = F.col("doc_id").cast("long")
    return F.coalesce(doc_id, F.lit(0)), F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(-2)).bitwiseOR(doc_id.isNull().cast("long"))


def judge(df: DataFrame, host_col: str = "source", max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """doc_id, the measures, base_failed, removed_words and kept, a row for each row of df."""
    own, lost, rows = _facts(df, host_col, max_docs)
    out = skew_join(own.drop("lines", "host"), lost.drop("gone"), ["k1", "k2"], "copies", rows, "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)))
    failed, fine = _verdict(max_removed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_words", (~failed & fine).alias("kept"))


def _verdict(max_removed: float) -> tuple[Column, Column]:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return failed, F.col("removed_words") <= max_removed * F.col("n_words")


def clean(df: DataFrame, host_col: str = "source", max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """The kept rows of df, their texts without the lines over the limit.  A hot
    document's list of lines is as long as its text."""
    own, lost, rows = _facts(df, host_col, max_docs)
    failed, fine = _verdict(max_removed)
    facts = own.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"), F.max("n_repeat_words").alias("n_repeat_words"), F.count("*").alias("rows")).join(lost.drop("copies"), ["k1", "k2"], "left")
    facts = facts.withColumn("removed_words", F.coalesce("removed", F.lit(0))).select("k1", "k2", (~failed & fine).alias("kept"), "gone", "rows")
    k1, k2, kept, gone, n = (fresh(df, c) for c in ("k1", "k2", "kept", "gone", "rows"))
    keyed = df.withColumn("text", F.col("text").cast("string")).withColumns(dict(zip((k1, k2), _key())))
    met = skew_join(keyed, cut(facts.toDF(k1, k2, kept, gone, n)), [k1, k2], n, rows).where(kept).select(*df.columns, gone)
    place, schema = df.columns.index("text"), met.drop(gone).schema

    def run(batches):
        for b in batches:
            texts = [t if t is None or not g else _without(t, set(g)) for t, g in zip(b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return arrow_map(met, run, schema)


def line_key(words: list[bytes]) -> int:
    """The hash of a normalised line."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words).decode().lower().encode(), digest_size=8).digest(), "little", signed=True)


def _without(text: str, gone: set[int]) -> str:
    keep = []
    for line in text.encode().split(b"\n"):
        w = line.split()
        if not w or line_key(w) not in gone:
            keep.append(line)
    return b"\n".join(keep).decode()


def _often(lines: DataFrame, max_docs: int) -> DataFrame:
    """(host, h, docs) of the lines over the limit."""
    return cut(lines.groupBy("host", "h").agg(F.count_distinct("k1", F.col("k2").bitwiseAND(F.lit(1))).alias("docs")).where(F.col("docs") > max_docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, '{_W}') AS w FROM d),
own AS (
  SELECT rid, doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
win AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT rid, doc_id, host, line, regexp_extract_all(line, '{_W}') AS w FROM ln),
full_lines AS (SELECT rid, doc_id, host, line, lower(array_to_string(w, ' ')) AS norm, len(w) AS n FROM lw WHERE len(w) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY rid),
often AS (SELECT host, norm FROM full_lines GROUP BY host, norm HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > {MAX_DOCS}),
lost AS (SELECT rid, sum(f.n) AS n FROM full_lines f JOIN often o ON f.host = o.host AND f.norm = o.norm GROUP BY rid)
SELECT own.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
       (n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words) AS base_failed,
       CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words,
       NOT (n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words) AND coalesce(lost.n, 0) <= {MAX_REMOVED} * n_words AS kept
FROM own LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)
"""
