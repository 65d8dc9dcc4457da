"""Vectorised text kernels over Arrow string columns.

Words are maximal runs of bytes that are neither ASCII punctuation, ASCII white space nor control characters;
ASCII and Latin-1 letters are folded to lower case. A null text counts as an empty one. Everything works on whole
texts: a chunk holds whole documents, and a document of any length is one chunk if need be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 4096
U64 = np.uint64

_FOLD = bytes(0 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_tables = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _tables
    if len(_tables[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _tables = (out[0], out[1])
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = np.asarray(x).astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column, nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def chunks(col: pa.Array, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about ``size`` bytes."""
    data, offs = buffers(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case, 0 where no word is."""
    out = np.frombuffer(bytearray(data.tobytes().translate(_FOLD)), np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        after = data[lead + 1]
        out[lead[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1] += np.uint8(0x20)
    return out


def _spans_hashed(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sum of byte * BASE**(place in the word) for each span, modulo 2**64."""
    if len(low) <= 4 * CHUNK_BYTES:
        up, down = _power_tables(len(low))
        total = np.zeros(len(low) + 1, U64)
        np.cumsum(low * up[: len(low)], out=total[1:])
        return (total[e] - total[s]) * down[s]
    lens = e - s
    at = np.zeros(len(s), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    k = np.arange(int(lens.sum()), dtype=np.int64)
    k -= np.repeat(at, lens)
    return np.add.reduceat(low[low != 0].astype(U64) * _power_tables(int(lens.max()))[0][k], at)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end byte of each word; offs bounds the rows."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, U64), none, none, none
    low = fold(data)
    ok = low != 0
    start, stop = ok.copy(), ok.copy()
    start[1:] &= ~ok[:-1]
    stop[:-1] &= ~ok[1:]
    bounds = offs[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    start[bounds] = ok[bounds]
    stop[bounds - 1] = ok[bounds - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    if not len(s):
        return np.zeros(0, U64), none, none, none
    h = mix(_spans_hashed(low, s, e) + (e - s).astype(U64))
    return h, np.searchsorted(offs, s, "right") - 1, s, e


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the word n-grams; a row of fewer words than n has one gram, of all its words."""
    if not len(h):
        return h, row
    if n == 1:
        return h, row
    g, r = np.zeros(0, U64), row[:0]
    if len(h) >= n:
        m = len(h) - n + 1
        g = h[:m].copy()
        for i in range(1, n):
            g = mix(g * U64(3) + h[i : i + m])
        whole = row[:m] == row[n - 1 :]
        g, r = g[whole], row[:m][whole]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    few = count < n
    if few.any():
        sel = np.repeat(few, count)
        pos = (np.arange(len(row)) - np.repeat(first, count))[sel].astype(U64)
        part = mix(h[sel] ^ mix(pos + U64(17)))
        at = (np.cumsum(count[few]) - count[few])
        g, r = np.r_[g, mix(np.add.reduceat(part, at))], np.r_[r, row[first[few]]]
    return g, r


def distinct(g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (52-bit hash, row), ordered by row and hash; rows below 4096."""
    key = np.sort((r.astype(U64) << U64(52)) | (g >> U64(12)))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return key & U64((1 << 52) - 1), (key >> U64(52)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of equal values of a sorted array."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])


class Blobs:
    """Gathers fixed-width records by target partition, to be shuffled as few binary rows.

    ``add`` takes a target for each record and arrays of one dtype each; ``flush`` yields Arrow batches
    (part int, blob binary). A blob holds the arrays one after another, preceded by the count.
    """

    SCHEMA = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
    DDL = "part int, blob binary"

    def __init__(self, parts: int, limit: int = 1 << 18):
        self.parts, self.limit, self.held, self.n = parts, limit, [], 0

    def add(self, target: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(target):
            self.held.append((target, *arrays))
            self.n += len(target)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        target, *arrays = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.argsort(target.astype(np.uint16 if self.parts <= 65536 else np.int64), kind="stable")
        target, arrays = target[order], [a[order] for a in arrays]
        first, count = runs(target)
        blobs = [b"".join([np.int64(c).tobytes(), *(a[f : f + c].tobytes() for a in arrays)]) for f, c in zip(first, count, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(target[first], pa.int32()), pa.array(blobs, pa.binary())], schema=self.SCHEMA)

    @staticmethod
    def read(blobs: list[bytes], *dtypes: type) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in dtypes]
        for b in blobs:
            n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
            for k, t in enumerate(dtypes):
                out[k].append(np.frombuffer(b, t, n, at))
                at += n * np.dtype(t).itemsize
        return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, dtypes, strict=True)]


def target_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a hash, from its high bits."""
    return (((key >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int32)
