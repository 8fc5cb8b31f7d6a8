"""Operator 10: byte-level BPE encoding and decoding by a global distinct-word
shuffle.

encode(): whole documents are cut into blocks of a few megabytes of text.  A
block's pre-tokens are exploded with their positions; its distinct words go to
buckets by hash, packed to one row for each block and bucket, and the positions
to one row of codes for each block.  All rows of a bucket meet in one task,
where each distinct word of the corpus is merged once; the ids go back to the
blocks in the order in which the words came, and the positions put them in
place.  A word is at most once in a block's rows, so no word can hold more
than one part in (distinct words of a block) of them, however frequent it is.

decode(): the token-byte table (bounded by the vocabulary) is joined to ids.

Defined results: null or empty text gives no ids; every row gives a row, also
repeated ones and null doc_id; other columns are ignored.  The scan must give
the same rows in the same order when a task runs again (files do); words and
positions of a block carry a checksum of its words, and an error is raised
where they differ.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnum as X
from .spark_util import arrow_map, blocks, extend, release, table

BLOCK_BYTES = 1 << 22


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging of one pre-token: the adjacent pair of least rank is
    merged, the leftmost first, until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 256:
        return _merge_long(parts, ranks)
    get = ranks.get
    none = len(ranks) + 1
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        least = min(pair)
        if least == none:
            break
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for very long pre-tokens."""
    import heapq

    n = len(parts)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], right[i] = a + b, False, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] >= 0 and (r := ranks.get(parts[k] + parts[right[k]])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[right[k]]))
    return [ranks[p] for p, on in zip(parts, alive) if on]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each pair (s, n), one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else np.zeros(0, np.int64)
    return flat[np.arange(total) + shift]


def block_words(data: np.ndarray, off: np.ndarray, buckets: int):
    """The distinct pre-tokens of a block of rows, by bucket and sorted within;
    the first of each bucket; the number of the pre-token at each position; and
    each row's first position.  Pre-tokens are told apart by hash; the bytes of
    all are compared, so no two words share a number."""
    starts, ends, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
    for lo, hi in X.spans(off, 1 << 18):
        part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        cp, co = X.code_points(part, o)
        s = X.pretoken_starts(cp, co)
        e = np.append(s[1:], len(cp))
        rows += (rows[-1] + np.searchsorted(s, co)[1:]).tolist()
        if len(cp) != len(part):
            byte = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
            s, e = byte[s], byte[e]
        starts.append(s + off[lo])
        ends.append(e[: len(s)] + off[lo])
    starts, ends, raw = np.concatenate(starts), np.concatenate(ends), data.tobytes()
    codes, distinct = pd.factorize(X.span_hashes(data, starts, ends))
    first = np.full(len(distinct), -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if not X.same_spans(data, starts, ends, first[codes]):  # two words of one hash: told apart by their bytes
        codes, kinds = pd.factorize(np.array([None, *(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))], object)[1:])
        reps = list(kinds)
        distinct = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in reps], X.U64)
    else:
        reps = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    bucket = (distinct % X.U64(buckets)).astype(np.int64)
    order = np.array(sorted(range(len(reps)), key=reps.__getitem__), np.int64) if reps else np.zeros(0, np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [reps[i] for i in order.tolist()], np.searchsorted(bucket[order], np.arange(buckets + 1)), rank[codes], np.asarray(rows, np.int64)


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by bytes of equal weight, which packs better."""
    return np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def checksum(words: list[bytes]) -> int:
    """Of a block's words in their order."""
    return int.from_bytes(hashlib.blake2b(b"\0".join(words) + len(words).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=5).compress(planes(np.array([len(w) for w in words], np.uint32)) + b"".join(words))


def unpack_words(packed: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(unplanes(raw[: 4 * n])) + 4 * n
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


HOT = 8  # words as frequent as that in a block get the least codes


def pack_positions(codes: np.ndarray, n_words: int) -> bytes:
    count = np.bincount(codes, minlength=n_words)
    hot = np.flatnonzero(count >= HOT)
    hot = hot[np.argsort(-count[hot], kind="stable")]
    to = np.arange(n_words) + len(hot)
    to[hot] = np.arange(len(hot))
    raw = len(hot).to_bytes(4, "little") + hot.astype("<u4").tobytes() + planes(to[codes])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack_positions(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    hot, codes = np.frombuffer(raw, "<u4", n, 4), unplanes(raw[4 + 4 * n :]).astype(np.int64)
    return np.where(codes < n, hot[np.minimum(codes, n - 1)] if n else 0, codes - n)


def _word_rows(limit: int, buckets: int):
    def run(batches):
        for block, rows in blocks(batches, 1, limit):
            data, off = X.utf8(rows.column(1))
            words, first, _, _ = block_words(data, off, buckets)
            check = checksum(words)
            for lo in range(0, buckets, 64):
                full = [b for b in range(lo, min(lo + 64, buckets)) if first[b + 1] > first[b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([int(first[b + 1] - first[b]) for b in full], pa.int64()), pa.array([pack_words(words[first[b] : first[b + 1]]) for b in full], pa.binary()), pa.array([check] * len(full), pa.int64())],
                    ["bucket", "block", "n", "words", "checksum"],
                )

    return run


def _position_rows(limit: int, buckets: int, kind: pa.DataType):
    def run(batches):
        for block, docs in blocks(batches, 1, limit):
            data, off = X.utf8(docs.column(1))
            words, _, codes, rows = block_words(data, off, buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([len(words)]), pa.array([checksum(words)]), pa.array([docs.column(0).cast(kind).to_pylist()], pa.list_(kind)), pa.array([rows.tolist()], pa.list_(pa.int64())), pa.array([pack_positions(codes, len(words))], pa.binary())],
                ["block", "n_words", "checksum", "doc_ids", "first", "positions"],
            )

    return run


def _encode_words(ranks):
    def run(batches):
        table_ = ranks.value
        at, known = None, {}
        for batch in batches:
            out = []
            for bucket, n, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if bucket != at:  # rows come sorted by bucket: each word is merged once
                    at, known = bucket, {}
                ids, lengths = [], []
                for w in unpack_words(packed, n):
                    got = known.get(w)
                    if got is None:
                        known[w] = got = merge(w, table_)
                    ids += got
                    lengths.append(len(got))
                out.append(zstandard.ZstdCompressor(level=3).compress(planes(np.array(lengths, np.uint32)) + planes(np.array(ids, np.uint32))))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(out, pa.binary()), batch.column(4)], ["block", "bucket", "n", "ids", "checksum"])

    return run


def _place(kind: pa.DataType, tokens=None):
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * (tokens is not None)
    types = [kind, pa.int64(), pa.binary()] + [pa.binary()] * (tokens is not None)

    def run(places: pa.Table, words: pa.Table) -> pa.Table:
        done = []
        parts = sorted(words.to_pylist(), key=lambda r: r["bucket"])
        lengths, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for r in parts:
            raw = zstandard.ZstdDecompressor().decompress(r["ids"])
            lengths.append(unplanes(raw[: 4 * r["n"]]).astype(np.int64))
            flat.append(unplanes(raw[4 * r["n"] :]))
        lengths, flat = np.concatenate(lengths), np.concatenate(flat)
        starts = np.cumsum(lengths) - lengths
        for row in places.to_pylist():
            if len(lengths) != row["n_words"] or any(r["checksum"] != row["checksum"] for r in parts):
                raise RuntimeError(f"the words of block {row['block']} are not those of its positions: the input's rows changed between two reads")
            codes = unpack_positions(row["positions"])
            ids = ragged(flat, starts[codes], lengths[codes])
            ends = np.concatenate([[0], np.cumsum(lengths[codes])])[np.asarray(row["first"], np.int64)]
            ids = ids.astype("<u4")
            cols = [pa.array(row["doc_ids"], kind), pa.array(np.diff(ends)), binary_column(ids, ends * 4)]
            if tokens is not None:
                cols.append(binary_column(*token_bytes(tokens.value, ids, ends)))
            done.append(pa.table(cols, names=names))
        release()
        return pa.concat_tables(done) if done else pa.table([pa.array([], t) for t in types], names=names)

    return run


def binary_column(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and each one's length by id."""
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    lengths = np.zeros(ordered[-1][1] + 1 if ordered else 0, np.int64)
    for token, i in ordered:
        lengths[i] = len(token)
    return np.frombuffer(b"".join(t for t, _ in ordered), np.uint8), lengths


def token_bytes(tokens: tuple[np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids (rows' ends among them) joined with the token-byte table."""
    flat, length = tokens
    out = ragged(flat, (np.cumsum(length) - length)[ids], length[ids])
    return out, np.concatenate([[0], np.cumsum(length[ids])])[ends]


def encode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens long, ids binary): ids as little-endian unsigned 32-bit
    integers; decoded adds what decode() makes of them, in the same tasks."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sql_kind = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.string() if sql_kind == "string" else pa.int32() if sql_kind == "int" else pa.int64()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n
    words = arrow_map(docs, _word_rows(block_bytes, buckets), "bucket int, block long, n long, words binary, checksum long")
    places = arrow_map(docs, _position_rows(block_bytes, buckets, kind), f"block long, n_words long, checksum long, doc_ids array<{sql_kind}>, first array<long>, positions binary")
    encoded = arrow_map(words.repartition(n, "bucket").sortWithinPartitions("bucket"), _encode_words(shared), "block long, bucket int, n long, ids binary, checksum long")
    tokens = spark.sparkContext.broadcast(token_table(ranks)) if decoded else None
    return places.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_place(kind, tokens), f"doc_id {sql_kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """df with a column decoded (binary): the bytes of its ids; null ids give none."""
    shared = df.sparkSession.sparkContext.broadcast(token_table(ranks))

    def run(column):
        parts = []
        for _, _, data, off in X.chunks(column, 1 << 22):
            parts.append(binary_column(*token_bytes(shared.value, np.frombuffer(data.tobytes(), "<u4"), off // 4)))
        return (pa.concat_arrays(parts) if parts else pa.array([], pa.binary()),)

    return extend(df, ids_col, run, "decoded binary")


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = default_ranks()
    done = encode(table(spark, sf_dir, "documents"), ranks, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
