"""Operator 9: line dedup by content-defined chunks of lines.

Lines with a word are hashed, and a rolling hash runs over each two successive
line hashes.  Chunk boundaries lie where the rolling hash changes between one
that the corpus has before and one that it hasn't, so a chunk is a maximal run
of lines that stand in that succession elsewhere: boundaries depend on the lines
alone and come back after any insertion, and no part of a repeated passage falls
outside of them (boundaries at fixed values of the hash lose heads and tails).
A run of MIN_WORDS words or more is removed, with the blank lines in it; a line
that has so many words is a run by itself if it occurs before.  The first
occurrence by (doc_id, text hash, place) stays, so the first occurrence of every
line does.

Documents are read in blocks of a few megabytes of text.  A block sends its
distinct hashes with their least occurrence to buckets by hash, one row for each
block and bucket, so a line in every document comes once from each block; a
bucket answers which of them occur elsewhere, and earlier.  The answers meet the
block's documents again, where the runs are cut out.  Before anything is
returned, the bytes behind all equal hashes are compared (least = greatest,
which needs no group in one place); if two differ, all is done again with
another salt.

Defined results: null text stays null; repeated rows (same doc_id and text)
are one document and keep the same lines; null doc_id sorts first; a document
may end up empty; all columns stay, n_lines, chunks_removed and words_removed
are added (in place of input columns of these names).  The scan must give the
same rows in the same order when a task runs again (files do); an error is
raised where a block's answers aren't for its hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import textnum as X
from .spark_util import arrow_map, blocks, cut, fresh, release, table

MIN_WORDS = 50
BLOCK_BYTES = 1 << 22
ADDED = ["n_lines", "chunks_removed", "words_removed"]
MORE = ", ".join(f"{c} long" for c in ADDED)


class Lines:
    """A text's lines with a word: their places, words, hashes, and the digests
    of the windows (one long line, or two lines) by slot: 2 j for line j, 2 j + 1
    for lines j and j + 1."""

    def __init__(self, raw: bytes, salt: int):
        self.all = raw.split(b"\n")
        counts = [len(x.split()) for x in self.all]
        self.at = [i for i, n in enumerate(counts) if n]
        self.words = [counts[i] for i in self.at]
        one = xxhash.xxh3_128_digest
        self.hashes = [one(self.all[i], salt) for i in self.at]
        self.slots = [2 * j for j, n in enumerate(self.words) if n >= MIN_WORDS]
        self.digests = [self.hashes[s // 2] for s in self.slots]
        h = self.hashes
        self.slots += range(1, 2 * len(h) - 1, 2)
        self.digests += [one(a + b, salt) for a, b in zip(h, h[1:])]

    def runs(self, gone: set[int]) -> list[tuple[int, int, int]]:
        """(first line, end line, words) of the runs under the slots in gone."""
        hit = [False] * (len(self.at) + 1)
        for s in gone:
            hit[s // 2] = True
            if s & 1:
                hit[s // 2 + 1] = True
        out, begin = [], None
        for j, on in enumerate(hit):
            if on and begin is None:
                begin = j
            elif not on and begin is not None:
                words = sum(self.words[begin:j])
                if words >= MIN_WORDS:
                    out.append((self.at[begin], self.at[j - 1] + 1, words))
                begin = None
        return out


class Block:
    """The windows of a block of documents, sorted by digest and occurrence;
    key: for each document (0 for a null id, the id, the text's hash)."""

    def __init__(self, texts: list[bytes | None], key: np.ndarray, salt: int):
        self.lines = [None if t is None else Lines(t, salt) for t in texts]
        docs = [x for x in self.lines if x is not None]
        number = np.flatnonzero([x is not None for x in self.lines])
        raw = b"".join(d for x in docs for d in x.digests)
        two = np.frombuffer(raw, "<u8").reshape(-1, 2)
        row = np.repeat(number, [len(x.slots) for x in docs])
        slot = np.array([s for x in docs for s in x.slots], np.int64)
        order = np.lexsort((slot, *key[row].T[::-1], two[:, 1], two[:, 0]))
        self.hi, self.lo, self.row, self.slot = two[order, 0], two[order, 1], row[order], slot[order]
        same = np.zeros(len(order), bool)
        same[1:] = (self.hi[1:] == self.hi[:-1]) & (self.lo[1:] == self.lo[:-1])
        self.first = np.flatnonzero(~same)  # the least occurrence of each distinct window
        self.group = np.cumsum(~same) - 1
        self.occurrence = np.column_stack([key[self.row], self.slot])

    def parts(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, numbers of its distinct windows in order of digest)."""
        bucket = (self.hi[self.first] % X.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        return [(int(bucket[part[0]]), part) for part in np.split(order, edge[1:]) if len(part)]

    def check(self) -> int:
        """A checksum of the block's distinct windows."""
        return int(X.mix64(self.hi[self.first] ^ X.mix64(self.lo[self.first])).sum(dtype=X.U64).view(np.int64)) if len(self.first) else 0


def keys_of(ids: list, hashes: list) -> np.ndarray:
    return np.array([(i is not None, i or 0, h or 0) for i, h in zip(ids, hashes)], np.int64).reshape(-1, 3)


def pack(hi: np.ndarray, lo: np.ndarray, occurrence: np.ndarray) -> bytes:
    """Columns by bytes of equal weight, which packs better."""
    columns = [hi.view(np.int64), lo.view(np.int64), *occurrence.T]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(6, 8, n)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<i8").reshape(6, n)


def _sender(salt: int, buckets: int):
    """Rows (block, part of the key, text) to one row for each block and bucket."""
    names = ["bucket", "block", "checksum", "n", "windows"]

    def run(batches):
        for block, batch in blocks(batches, 2, BLOCK_BYTES):
            b = Block(texts_of(batch.column(2)), keys_of(batch.column(0).to_pylist(), batch.column(1).to_pylist()), salt)
            parts, check = b.parts(buckets), b.check()
            for lo in range(0, len(parts), 64):
                some = parts[lo : lo + 64]
                packed = [pack(b.hi[b.first[p]], b.lo[b.first[p]], b.occurrence[b.first[p]]) for _, p in some]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([check] * len(some), pa.int64()), pa.array([len(p) for _, p in some], pa.int64()), pa.array(packed, pa.binary())], names)

    return run


def texts_of(column) -> list[bytes | None]:
    return [None if t is None else t.encode() for t in column.to_pylist()]


def states(windows: list[np.ndarray]) -> list[np.ndarray]:
    """For each block's windows of a bucket: 0 in no other block, 1 in another
    one, but here first, 2 earlier in another one."""
    sizes = [w.shape[1] for w in windows]
    hi, lo, *occurrence = np.concatenate(windows, axis=1)
    order = np.lexsort((*occurrence[::-1], lo, hi))
    same = np.zeros(len(order), bool)
    same[1:] = (hi[order][1:] == hi[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    first = np.flatnonzero(~same)[np.cumsum(~same) - 1]
    least = np.ones(len(order), bool)  # copies of a document in other blocks are the same occurrence
    for c in occurrence:
        least &= c[order] == c[order][first]
    alone = np.bincount(np.cumsum(~same) - 1)[np.cumsum(~same) - 1] == 1 if len(order) else same
    out = np.empty(len(order), np.uint8)
    out[order] = np.where(alone, 0, np.where(least, 1, 2))
    return np.split(out, np.cumsum(sizes)[:-1])


def _answer(batches):
    """Rows sorted by bucket to (block, bucket, checksum, states)."""
    names = ["block", "bucket", "checksum", "states"]

    def answers(bucket, rows):
        found = states([unpack(w, n) for _, _, n, w in rows])
        packed = [zstandard.ZstdCompressor().compress(s.tobytes()) for s in found]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array(packed, pa.binary())], names)

    at, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                if rows:
                    yield answers(at, rows)
                at, rows = bucket, []
            rows.append(row)
    if rows:
        yield answers(at, rows)


PIECES = "array<struct<h1: bigint, h2: bigint, bytes: binary>>"


def _remove(names: list[str], inner: tuple[str, str, str, str], text_col: str, schema: pa.Schema, salt: int, buckets: int):
    """A block's documents and its answers to documents without repeated runs."""
    k1, k2, block, pieces_col = inner

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        place = docs.column_names.index(text_col)
        texts = texts_of(docs.column(place))
        b = Block(texts, keys_of(docs.column(k1).to_pylist(), docs.column(k2).to_pylist()), salt)
        answer = {r["bucket"]: r for r in told.to_pylist()}
        parts, check = b.parts(buckets), b.check()
        state = np.zeros(len(b.first), np.uint8)
        for bucket, p in parts:
            r = answer.get(bucket)
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["states"]), np.uint8) if r else ()
            if not r or r["checksum"] != check or len(got) != len(p):
                raise RuntimeError("a block's answers are not for its lines: the input's rows changed between two reads")
            state[p] = got
        occurrences = np.bincount(b.group, minlength=len(b.first)) if len(b.first) else state
        least = b.first[b.group]
        gone = (state[b.group] == 2) | (b.occurrence != b.occurrence[least]).any(axis=1)
        slots: dict[int, set[int]] = {}
        for r, s in zip(b.row[gone].tolist(), b.slot[gone].tolist()):
            slots.setdefault(r, set()).add(s)
        proof: list[list[dict]] = [[] for _ in texts]
        known: set[bytes] = set()
        for i in b.first[(state > 0) | (occurrences > 1)].tolist():
            x, r, s = b.lines[b.row[i]], int(b.row[i]), int(b.slot[i])
            for j in {s // 2, (s + 1) // 2}:
                if x.hashes[j] not in known:
                    known.add(x.hashes[j])
                    proof[r].append(_piece(x.hashes[j], x.all[x.at[j]]))
            if s & 1:
                j = s // 2
                proof[r].append({"h1": int(b.hi[i].view(np.int64)), "h2": int(b.lo[i].view(np.int64)), "bytes": b"\n" + x.hashes[j] + x.hashes[j + 1]})
        new, n_lines, n_chunks, n_words = [], [], [], []
        for r, x in enumerate(b.lines):
            runs = x.runs(slots[r]) if r in slots else []
            n_lines.append(0 if x is None else len(x.all))
            n_chunks.append(len(runs))
            n_words.append(sum(w for _, _, w in runs))
            if runs:
                keep, at = [], 0
                for lo, hi, _ in runs:
                    keep += x.all[at:lo]
                    at = hi
                new.append(b"\n".join(keep + x.all[at:]).decode())
            else:
                new.append(None if texts[r] is None else texts[r].decode())
        columns = [pa.array(new, pa.string()) if n == text_col else docs.column(n) for n in names]
        columns += [pa.array(n_lines, pa.int64()), pa.array(n_chunks, pa.int64()), pa.array(n_words, pa.int64()), pa.array(proof, schema.field(pieces_col).type)]
        out = pa.table(columns, names=[*names, *ADDED, pieces_col])
        release()
        return out

    return run


def _piece(digest: bytes, text: bytes) -> dict:
    return {"h1": int.from_bytes(digest[:8], "little", signed=True), "h2": int.from_bytes(digest[8:], "little", signed=True), "bytes": text}


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: int = 0) -> DataFrame:
    """df with repeated runs of lines removed from its texts, and the columns of MORE."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    docs = df.drop(*[c for c in ADDED if c in df.columns])
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    names = docs.columns
    k1, k2, block, pieces = inner = tuple(fresh(docs, x) for x in ("k1", "k2", "block", "pieces"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n
    keyed = docs.withColumns({k1: F.col(id_col).cast("long"), k2: F.xxhash64(text_col)})
    sent = arrow_map(keyed.select(k1, k2, text_col), _sender(salt, buckets), "bucket int, block long, checksum long, n long, windows binary")
    sorted_ = sent.repartition(n, "bucket").sortWithinPartitions("bucket")
    told = arrow_map(sorted_, _answer, "block long, bucket int, checksum long, states binary")
    whole = StructType.fromDDL(f"{MORE}, `{pieces}` {PIECES}")
    schema = StructType([*docs.schema.fields, *whole.fields])
    place = keyed.columns.index(text_col)

    def number(batches):
        for at, rows in blocks(batches, place, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([at] * rows.num_rows, pa.int64())], [*rows.schema.names, block])

    numbered = arrow_map(keyed, number, StructType([*keyed.schema.fields, *StructType.fromDDL(f"`{block}` long").fields]))
    remove = _remove(names, inner, text_col, to_arrow_schema(schema), salt, buckets)
    done = cut(numbered.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(remove, schema))
    seen = done.select(F.inline(pieces))
    if seen.groupBy("h1", "h2").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a != b").limit(1).count():
        return dedup(df, id_col, text_col, salt + 1)
    return done.drop(pieces)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "chunks_removed", "words_removed", "text")


_N = r"len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))"
SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
k AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS rid, doc_id, text FROM d),
s AS (SELECT rid, string_split(text, chr(10)) AS ls FROM k WHERE text IS NOT NULL),
l AS (SELECT rid, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM s),
h AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS j FROM (SELECT rid, i, line, {_N} AS n FROM l) WHERE n > 0),
p AS (SELECT rid, j, j + 1 AS e, line || chr(10) || lead(line) OVER (PARTITION BY rid ORDER BY j) AS t FROM h),
w AS (SELECT * FROM p WHERE t IS NOT NULL UNION ALL SELECT rid, j, j AS e, line AS t FROM h WHERE n >= {MIN_WORDS}),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rid, j) AS k FROM w),
c AS (SELECT DISTINCT rid, unnest([j, e]) AS j FROM o WHERE k > 1),
g AS (SELECT h.rid, h.j, h.i, h.n, h.j - row_number() OVER (PARTITION BY h.rid ORDER BY h.j) AS run FROM h JOIN c ON c.rid = h.rid AND c.j = h.j),
r AS (SELECT rid, min(i) AS a, max(i) AS b, sum(n) AS n FROM g GROUP BY rid, run HAVING sum(n) >= {MIN_WORDS}),
kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = l.rid AND l.i BETWEEN r.a AND r.b) GROUP BY l.rid),
n AS (SELECT rid, count(*) AS n FROM l GROUP BY rid),
z AS (SELECT rid, count(*) AS c, sum(n) AS n FROM r GROUP BY rid)
SELECT q.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(z.c, 0) AS BIGINT) AS chunks_removed, CAST(coalesce(z.n, 0) AS BIGINT) AS words_removed,
       CASE WHEN q.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents q JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.text IS NOT DISTINCT FROM k.text
LEFT JOIN n USING (rid) LEFT JOIN z USING (rid) LEFT JOIN kept USING (rid)
"""
