"""Vectorised text primitives shared by the operators of this subpackage.

All functions work on the UTF-8 buffer of an Arrow string column, a few
megabytes of whole rows at a time, so Python touches only very long words.
A word's hash chains a bijective mixer over its pieces of eight bytes; words
of more than LONG_WORD bytes are hashed whole by BLAKE2.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD1342543DE82EF95 | 1
CHUNK_BYTES = 1 << 20
LONG_WORD = 128
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most limit bytes, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = max(lo + 1, min(hi, n))
        yield lo, hi
        lo = hi


def chunks(column, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets from 0) over whole rows."""
    data, off = utf8(column)
    for lo, hi in spans(off, limit):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs without ASCII white space,
    and for each row (plus one) the number of its first word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = (data != 32) & ((data - np.uint8(9)) > 4)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:])
    edge[off[:-1][off[:-1] < n]] = True
    at = np.flatnonzero(edge)
    end = np.append(at[1:], n)
    keep = solid[at]
    starts, ends = at[keep], end[keep]
    return starts, ends, np.searchsorted(starts, off)


def eights(data: np.ndarray) -> np.ndarray:
    """The little-endian number of the eight bytes from each place on (zeros after the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span of bytes."""
    length, at = ends - starts, eights(data)
    h = mix64(length.astype(U64) * U64(_BASE) + U64(_BASE2))
    on, done = np.flatnonzero((length > 0) & (length <= LONG_WORD)), 0
    while len(on):
        left = length[on] - done
        h[on] = mix64((h[on] ^ (at[starts[on] + done] & _MASK[np.minimum(left, 8)])) * U64(_BASE))
        on, done = on[left > 8], done + 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether the bytes of each span equal those of the span whose number other has."""
    length = ends - starts
    if not np.array_equal(length, length[other]):
        return False
    at, on, done = eights(data), np.flatnonzero((length > 0) & (length <= LONG_WORD) & (other != np.arange(len(other)))), 0
    while len(on):
        left = length[on] - done
        if (((at[starts[on] + done] ^ at[starts[other[on]] + done]) & _MASK[np.minimum(left, 8)]) != 0).any():
            return False
        on, done = on[left > 8], done + 8
    return all(np.array_equal(data[starts[i] : ends[i]], data[starts[other[i]] : ends[other[i]]]) for i in np.flatnonzero((length > LONG_WORD) & (other != np.arange(len(other)))).tolist())


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's first word number."""
    starts, ends, first = words(data, off)
    return span_hashes(data, starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside rows, the position of each one's
    first word, and each row's first window number.  whole: a row of 1 to k-1
    words gives one window of all its words."""
    n, counts = len(hashes), np.diff(first)
    if n < k:
        h, at = np.zeros(0, U64), np.zeros(0, np.int64)
        starts = np.zeros(len(first), np.int64)
    else:
        h = hashes[: n - k + 1].copy()
        m = 1
        for j in range(1, k):
            m = m * _BASE2 & 0xFFFFFFFFFFFFFFFF
            h += hashes[j : n - k + 1 + j] * U64(m)
        row_end = np.repeat(first[1:], counts)
        at = np.flatnonzero(np.arange(n - k + 1) + k <= row_end[: n - k + 1])
        h = mix64(h[at])
        starts = np.searchsorted(at, first)
    if whole:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            extra, m = counts[few].astype(U64), 1
            for j in range(k - 1):
                on = np.flatnonzero(counts[few] > j)
                extra[on] += hashes[first[few[on]] + j] * U64(m)
                m = m * _BASE2 & 0xFFFFFFFFFFFFFFFF
            extra = mix64(extra)
            place = starts[few]
            h, at = np.insert(h, place, extra), np.insert(at, place, first[few])
            starts = np.concatenate([[0], np.cumsum(np.diff(starts) + ((counts > 0) & (counts < k)))])
    return h, at, starts


_classes: np.ndarray | None = None
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 other."""
    global _classes
    if _classes is None:
        out = np.zeros(sys.maxunicode + 1, np.uint8)
        cat = unicodedata.category
        for c in range(sys.maxunicode + 1):
            k = cat(chr(c))[0]
            if k == "L":
                out[c] = 1
            elif k == "N":
                out[c] = 2
        out[SPACES] = 3
        _classes = out
    return _classes


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of valid UTF-8 rows and the row offsets among them."""
    if len(data) == 0:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    lead = (data & 0xC0) != 0x80
    if lead.all():
        return data.astype(np.uint32), off
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    count = np.empty(len(data) + 1, np.int64)
    count[0] = 0
    np.cumsum(lead, out=count[1:])
    return cp, count[off]


def pretoken_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the matches of the byte-level BPE split pattern

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    begin, in rows that are matched separately.  The pattern cuts a text into
    runs of one class; the last blank of a white-space run joins the run that
    follows; an apostrophe that is a run of its own takes its suffix letters."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = classes()[cp]
    fresh = np.zeros(n, bool)
    fresh[off[:-1][off[:-1] < n]] = True
    run = fresh.copy()
    run[1:] |= cls[1:] != cls[:-1]
    run[0] = True
    start = run.copy()
    after = np.flatnonzero(run & (cls != 3) & ~fresh)
    after = after[after > 0]
    after = after[cls[after - 1] == 3]
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[run[quote] & ~fresh[quote + 1] & (cls[quote + 1] == 1)]
    if len(quote):
        a = cp[quote + 1]
        second = np.minimum(quote + 2, n - 1)
        same = (quote + 2 < n) & ~run[second]
        b = np.where(same, cp[second], 0)
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        one = np.isin(a, [ord(c) for c in "stmd"])
        hit = one | two
        q, length = quote[hit], np.where(two, 2, 1)[hit]
        start[q + 1] = False
        rest = q + 1 + length
        start[rest[rest < n]] = True
    return np.flatnonzero(start)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def folded(data: np.ndarray) -> np.ndarray:
    """Same length: ASCII and Latin-1 letters in lower case, other ASCII bytes
    as blanks, what else there is unchanged."""
    out = _FOLD[data]
    if len(data) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[up] += 32
    return out


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; empty rows give 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=np.float64)
    return out


def row_max(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.float64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, first[full])
    return out


def row_any(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, bool)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(flags.view(np.uint8), first[full]) > 0
    return out
