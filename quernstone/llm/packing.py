"""Operator 5: token ids packed into fixed-length rows, best fit decreasing.

Whole documents become ids (each distinct word of a block is encoded once),
with an end token each.  A document longer than a row is split into full rows
and a rest, so nothing is lost; the pieces of a shard are placed longest first,
each into the fullest row that still has room, which a segment tree over the
capacities finds in log(length) steps.  A shard is a stretch of about SHARD_BYTES
of text of an input partition, packed where it is read: nothing is shuffled, so
no source, repeated row or group of copies can gather anywhere.  Which documents
share a row follows from the input's files and splits; a task that runs again
packs the same.

A packed row: ids (binary matrix row of `length` little-endian numbers of
`width` bytes, filled up with the end token), cu_seqlens (0, then the ends of
its segments), resets (where positions start again at 0; one more at the
filling), doc_ids and pieces (number of the piece within its document, from 0).

Defined results: null and empty texts are one end token; repeated rows are
documents each; null doc_id stays null in doc_ids; other columns are ignored;
an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, textnum as X
from .spark_util import arrow_map, table

LENGTH = 2048
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 12 << 20


class CapacityTree:
    """How many open rows have which room; finds the least room >= need."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row with room for need, taken out."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not count[i]:
                    i += 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the items in each row; every length is 1 to capacity."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        got = tree.take(n)
        if got is None:
            rows.append([i])
            tree.add(capacity - n, len(rows) - 1)
        else:
            rows[got[1]].append(i)
            tree.add(got[0] - n, got[1])
    return rows


def width_of(top: int) -> int:
    return 2 if top < 1 << 16 else 4


def _pack(shared, length: int, end: int, width: int, shard_bytes: int):
    """Rows (doc_id, text) to the columns of PACKED."""
    state: dict = {}

    def encoder():
        if not state:
            import public_tokenizers
            import tiktoken

            known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=shared.value, special_tokens={})
            state["one"] = known.encode_ordinary  # a pre-token alone is split into itself
        return state["one"]

    def run(batches):
        from pyspark import TaskContext

        one, part = encoder(), TaskContext.get().partitionId()
        docs, size, number = [], 0, 0
        for batch in batches:
            for lo, hi, data, off in X.chunks(batch.column(1), min(BLOCK_BYTES, shard_bytes)):
                words, _, codes, first = bpe.block_words(data, off, 1)
                lists = [one(w.decode()) for w in words]
                lengths = np.array([len(x) for x in lists], np.int64)
                flat = np.array([i for x in lists for i in x], f"<u{width}")
                ids = bpe.ragged(flat, (np.cumsum(lengths) - lengths)[codes], lengths[codes]).tobytes()
                ends = (np.concatenate([[0], np.cumsum(lengths[codes])])[first] * width).tolist()
                docs += [(d, ids[a:b]) for d, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), ends, ends[1:])]
                size += len(data)
                if size >= shard_bytes:
                    yield pack_shard((part << 32) + number, docs, length, end, width)
                    docs, size, number = [], 0, number + 1
        if docs:
            yield pack_shard((part << 32) + number, docs, length, end, width)

    return run


PACKED = "shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>"


def pack_shard(shard: int, docs: list[tuple], length: int, end: int, width: int) -> pa.RecordBatch:
    """docs: (doc_id, ids) of one shard, in any order."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    items = []  # document, piece, first token, tokens
    arrays = []
    for i, (_, raw) in enumerate(docs):
        ids = np.append(np.frombuffer(raw, f"<u{width}"), np.array(end, f"<u{width}"))
        arrays.append(ids)
        items += [(i, k, a, min(length, len(ids) - a)) for k, a in enumerate(range(0, len(ids), length))]
    rows = best_fit_decreasing([x[3] for x in items], length)
    out: list[list] = [[] for _ in range(8)]
    for number, row in enumerate(rows):
        parts = [items[i] for i in row]
        cu = [0, *np.cumsum([p[3] for p in parts]).tolist()]
        ids = np.full(length, end, f"<u{width}")
        for p, a in zip(parts, cu):
            ids[a : a + p[3]] = arrays[p[0]][p[2] : p[2] + p[3]]
        values = (shard, number, cu[-1], ids.tobytes(), cu, cu[:-1] + ([cu[-1]] if cu[-1] < length else []), [docs[p[0]][0] for p in parts], [p[1] for p in parts])
        for column, v in zip(out, values):
            column.append(v)
    i32 = pa.int32()
    kinds = [pa.int64(), i32, i32, pa.binary(), pa.list_(i32), pa.list_(i32), pa.list_(pa.int64()), pa.list_(i32)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["shard", "row", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "pieces"])


def pack(df: DataFrame, ranks: dict[bytes, int], end: int, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns of PACKED; ids of end + 1 kinds at most."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    return arrow_map(docs, _pack(shared, length, end, width_of(end), shard_bytes), PACKED)


def position_ids(resets: list[int], length: int) -> np.ndarray:
    """The positions of a packed row: they start again at 0 at each reset."""
    at = np.zeros(length, np.int64)
    at[resets] = resets
    return np.arange(length) - np.maximum.accumulate(at)


def write(df: DataFrame, path: str) -> None:
    """Packed rows as Parquet: the ids column is the matrix, a row each."""
    df.write.option("compression", "zstd").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.default_ranks()
    return pack(table(spark, sf_dir, "documents"), ranks, end=len(ranks))
