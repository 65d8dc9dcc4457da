"""N-gram Jaccard join by parity sketches (operator 1).

Each document is the set of its word n-grams. An n-gram flips bits of a sketch (XOR), so two sketches differ in at
most as many bits as the sets differ in members: the Hamming distance bounds the symmetric difference from below.
Jaccard >= t means a symmetric difference of at most D = (1 - t) / (1 + t) * (|A| + |B|).

1. One pass gives each document its set's identity (``node``), size and a parity sketch of about one bit a member.
   Documents of equal sets share a node, so exact copies cost nothing further.
2. A sample of at most ``SAMPLE`` documents counts how often n-grams fall into each of 2**``CELLS`` cells; the cell's level
   and then the hash order all n-grams, rare ones first. The sample sets the speed alone: any order gives the same result.
3. A second pass writes the first |A| - ceil(t |A|) + 1 members of each set in that order as keys, packed as binary rows.
   Two sets with Jaccard >= t share at least ceil(t |A|) members, hence one of these of both, whatever their sizes.
4. All pairs of nodes with an equal key are candidates, unless their sizes, the members left from the key on, or, between
   sets under LARGE members, 64-bit sketches forbid it. A row of a larger set knows the key before its own: a pair that
   agrees on it is given there. Buckets of up to ALL_PAIRS nodes give their pairs. Of a larger one only links to its first
   node and between neighbours are tried at first, which finds most of any group of near copies; once those links are
   components, its nodes are compared tile by tile, and the pairs of different components are given. So no group of copies
   is ever written out as pairs.
5. The sketches' Hamming distance discards pairs. The nodes of each component of the rest are brought together once, in
   blocks of bounded size of which every two meet in a task, and there all pairs of the component, candidates or not,
   are compared by size, sketch and exact Jaccard. A task gives each node's number of links and a label of its class.

The result has one row a document: its class (least id of the documents joined by chains of links) and the number of
other documents with Jaccard >= t, copies of equal sets included. Its size is that of the input, whatever the groups.

Null ids take no part; null and empty texts have no n-grams and match nothing; texts of fewer than n words have one
n-gram. Rows repeated under one id count once; if their texts differ, their links are added and the least class is
given. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import classes, connected_components, in_blocks, linked, meeting
from .kernel import U64, Blobs, chunks, distinct, grams, mix, runs, signed, target_of, words
from .shared import as_long, dropped, moved, shuffle_partitions, small_side, written

N, THRESHOLD = 2, 0.7
#: Documents whose n-grams are counted to order all of them, by 2**CELLS cells in SHARES parts.
SAMPLE, CELLS, SHARES = 50_000, 22, 16
#: Buckets beyond ALL_PAIRS nodes are compared in tiles of TILE pairs; pairs are handed on by HANDED.
ALL_PAIRS, TILE, HANDED = 64, 1 << 20, 1 << 20
#: What a key's row knows: members before the key; a 64-bit sketch of sets under LARGE members, of others the key before.
DIGESTS = np.dtype([("at", np.uint32), ("w", U64)])
LARGE = 128
#: Nodes and members of a block of a component.
BLOCK_NODES, BLOCK_MEMBERS = 4096, 1_500_000


def limit_of(total: np.ndarray | int, t: float) -> np.ndarray:
    """Largest symmetric difference of two sets of ``total`` members in all whose Jaccard is at least t."""
    return np.floor((1 - t) / (1 + t) * total + 1e-9).astype(np.int64)


def prefix_of(size: np.ndarray, t: float) -> np.ndarray:
    """Members of which one at least is shared with any set whose Jaccard is at least t, in whatever order."""
    return np.where(size > 0, size - np.ceil(t * size - 1e-9).astype(np.int64) + 1, 0)


def gram_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members (52-bit hashes, by row), each row's first member and size, and its node."""
    h, row, _, _ = words(data, offs)
    g, r = distinct(*grams(h, row, n))
    rows = len(offs) - 1
    size = np.bincount(r, minlength=rows)
    first = np.cumsum(size) - size
    total = np.zeros(rows, U64)
    some = size > 0
    if some.any():
        total[some] = np.add.reduceat(mix(g), first[some])
    return g, first, size, mix(total + size.astype(U64))


def _sketches(g: np.ndarray, size: np.ndarray, words: np.ndarray | int) -> list[np.ndarray] | np.ndarray:
    """Parity sketches of sets that lie one after another in ``g``; of ``words`` 64-bit words each, a power of two."""
    words = np.broadcast_to(np.asarray(words), size.shape)
    first = np.cumsum(words) - words
    k = np.repeat(np.arange(len(size)), size)
    bit = first[k] * 64 + ((g >> U64(4)).astype(np.int64) & (words[k] * 64 - 1))
    return np.packbits((np.bincount(bit, minlength=int(words.sum()) * 64) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _words_of(size: np.ndarray) -> np.ndarray:
    """64-bit words of a set's sketch: about one bit a member."""
    return np.maximum(1, 2 ** np.ceil(np.log2(np.maximum(size, 1)) - 1e-9).astype(np.int64) // 64)


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits; the longer sketch is folded onto the shorter one, which keeps the bound."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


NODES = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])


def _nodes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Node, size and sketch of each id; null for texts without words."""
    for b in batches:
        for i, j, data, offs in chunks(b.column(1)):
            g, _, size, node = gram_sets(data, offs, n)
            none, words = size == 0, _words_of(size)
            sketch = _sketches(g, size, words).tobytes()
            ends = pa.array(np.r_[0, np.cumsum(8 * words)].astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(size), [None, ends.buffers()[1], pa.py_buffer(sketch)])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(signed(node), mask=none), pa.array(size), column], schema=NODES)


def _cells(g: np.ndarray) -> np.ndarray:
    return (g >> U64(52 - CELLS)).astype(np.int64)


def _occurring(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Cells of the n-grams of some texts, towards the share of the cell."""
    out = Blobs(SHARES)
    for b in batches:
        for _, _, data, offs in chunks(b.column(0)):
            cell = _cells(gram_sets(data, offs, n)[0])
            yield from out.add((cell * SHARES >> CELLS).astype(np.int32), cell.astype(np.uint32))
    yield from out.flush()


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eight levels for each doubling of the count of a cell."""
    count: dict[int, np.ndarray] = {}
    width = (1 << CELLS) // SHARES
    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
            (cell,) = Blobs.read([blob], np.uint32)
            count[part] = count.get(part, 0) + np.bincount(cell.astype(np.int64) - part * width, minlength=width)
    for part, n in count.items():
        level = np.minimum(8 * np.log2(1 + n), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], schema=Blobs.SCHEMA)


def levels_of(texts: DataFrame, rows: int, n: int) -> np.ndarray:
    """How common the n-grams of each cell are, in a sample of the texts (id, text)."""
    every = -(-rows // SAMPLE)
    some = texts if every <= 1 else texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    packed = some.select("text").mapInArrow(partial(_occurring, n=n), Blobs.DDL)
    out = np.zeros(1 << CELLS, np.uint8)
    width = len(out) // SHARES
    for r in packed.repartitionById(SHARES, F.col("part")).mapInArrow(_levels, Blobs.DDL).toLocalIterator():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.blob, np.uint8)
    return out


def _keys(batches: Iterator[pa.RecordBatch], n: int, t: float, parts: int, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = Blobs(parts)
    for b in batches:
        for _, _, data, offs in chunks(b.column(1)):
            g, first, size, node = gram_sets(data, offs, n)
            row = np.repeat(np.arange(len(size)), size)
            g = g[np.argsort((row << 8) | level[_cells(g)], kind="stable")]  # equal levels stay in the order of hashes
            at = np.arange(len(g)) - first[row]
            use = np.flatnonzero(at < prefix_of(size, t)[row])
            row, at, key = row[use], at[use], mix(g[use])
            w = np.where(at > 0, np.r_[U64(0), key[:-1]], U64(0)) if len(key) else key  # 0 agrees with none
            few = np.flatnonzero(size[row] < LARGE)
            w[few] = _sketches(g, size, 1)[row[few]]
            mark = np.empty(len(key), DIGESTS)
            mark["at"], mark["w"] = at, w
            yield from out.add(target_of(key, parts), key, node[row], size[row].astype(np.uint32), mark)
    yield from out.flush()


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MET_DDL = "a bigint, b bigint, key bigint, node bigint, size bigint, mark binary"
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("mark", pa.binary())])


class _Buckets:
    """Rows of keys shared by two nodes or more, ordered by key and node, and the pairs among them.

    Pairs of one ``comp`` aren't wanted.
    """

    def __init__(self, t: float, key: np.ndarray, node: np.ndarray, size: np.ndarray, mark: np.ndarray, comp: np.ndarray | None = None):
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        same = sorted_[1:] == sorted_[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]] if len(key) > 1 else order[:0]
        order = order[np.lexsort((node[order], key[order]))]
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
        order = order[new]
        self.t, self.key, self.node, self.size, self.mark = t, key[new], node[new], size[order].astype(np.int64), mark[order]
        self.left, self.w = self.size - self.mark["at"], self.mark["w"]
        self.comp = None if comp is None else comp[order]
        self.first, self.count = runs(self.key)

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a pair may be similar if it shares no member before the key."""
        p, q = self.size[x], self.size[y]
        most = limit_of(p + q, self.t)
        ok = (p + q - 2 * np.minimum(self.left[x], self.left[y]) <= most) & (np.minimum(p, q) >= self.t * np.maximum(p, q) - 1e-9)
        return ok & ((np.maximum(p, q) >= LARGE) | (np.bitwise_count(self.w[x] ^ self.w[y]) <= most))

    def wanted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a pair is first met here, and may be similar."""
        met = (np.minimum(self.size[x], self.size[y]) >= LARGE) & (self.w[x] == self.w[y]) & (self.w[x] != 0)
        ok = self.similar(x, y) & ~met
        return ok if self.comp is None else ok & (self.comp[x] != self.comp[y])

    def narrow(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of buckets of up to ALL_PAIRS nodes."""
        live = np.flatnonzero(np.repeat(self.count, self.count) <= ALL_PAIRS)
        for d in range(1, ALL_PAIRS):
            live = live[live + d < len(self.key)]
            live = live[self.key[live] == self.key[live + d]]
            if not len(live):
                break
            ok = live[self.wanted(live, live + d)]
            yield ok, ok + d

    def wide(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the larger buckets, tile by tile."""
        for f, c in zip(self.first[self.count > ALL_PAIRS].tolist(), self.count[self.count > ALL_PAIRS].tolist(), strict=True):
            across, down = min(c, 1 << 14), max(1, TILE // min(c, 1 << 14))
            for i in range(f, f + c, down):
                for j in range(i, f + c, across):
                    x, y = np.arange(i, min(i + down, f + c))[:, None], np.arange(j, min(j + across, f + c))[None, :]
                    r, s = np.nonzero(self.wanted(x, y) & (x < y))
                    yield r + i, s + j

    def stars(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the larger buckets, each node with the first and the one before."""
        count = np.repeat(self.count, self.count)
        rest = np.flatnonzero((count > ALL_PAIRS) & np.r_[False, self.key[1:] == self.key[:-1]][: len(self.key)])
        for other in (np.repeat(self.first, self.count)[rest], rest - 1):
            ok = self.similar(other, rest)
            yield other[ok], rest[ok]

    def given(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct pairs of nodes, the lesser first, by HANDED."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def handed() -> tuple[np.ndarray, np.ndarray]:
            x, y = (self.node[np.concatenate(v)] for v in zip(*held, strict=True))
            a, b = np.minimum(signed(x), signed(y)), np.maximum(signed(x), signed(y))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            return a[new], b[new]

        for x, y in pairs:
            if len(x):
                held.append((x, y))
                n += len(x)
            if n >= HANDED:
                yield handed()
                held, n = [], 0
        if held:
            yield handed()


def _met(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) to be looked at, and rows (key, node, size, mark) of the buckets of over ALL_PAIRS nodes."""
    read = Blobs.read([blob for b in batches for blob in b.column("blob").to_pylist()], U64, U64, np.uint32, DIGESTS)
    own = _Buckets(t, *read)
    del read
    for pairs in (own.narrow(), own.stars()):
        for a, b in own.given(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in list(MET)[2:])], schema=MET)
    rows = np.flatnonzero(np.repeat(own.count, own.count) > ALL_PAIRS)
    for f in range(0, len(rows), 1 << 16):
        at = rows[f : f + (1 << 16)]
        wide = pa.Array.from_buffers(pa.binary(DIGESTS.itemsize), len(at), [None, pa.py_buffer(own.mark[at].tobytes())]).cast(pa.binary())
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(signed(own.key[at])), pa.array(signed(own.node[at])), pa.array(own.size[at]), wide], schema=MET)


def _crossed(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different components of the rows (key, node, size, mark, comp) of large buckets."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    got = pa.Table.from_batches(held).combine_chunks()
    mark = np.frombuffer(b"".join(got.column("mark").to_pylist()), DIGESTS)
    key, node, size, comp = (got.column(c).to_numpy() for c in ("key", "node", "size", "comp"))
    found = _Buckets(t, key.view(U64), node.view(U64), size, mark, comp)
    for a, b in found.given(found.wide()):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGES)


def _near(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
        d = limit_of(b.column(2).to_numpy() + b.column(3).to_numpy(), t)
        keep = [hamming(p, q) <= k for p, q, k in zip(x, y, d, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=EDGES).filter(pa.array(keep, pa.bool_()))


LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("up", pa.int64())])


class _Group:
    """Sets of one block of a component, or of two, and all their pairs of Jaccard >= t."""

    def __init__(self, cross: bool):
        self.cross = cross
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, node: np.ndarray, weight: np.ndarray, block: np.ndarray, texts: pa.Array, n: int) -> None:
        for i, j, data, offs in chunks(texts):
            g, _, size, found = gram_sets(data, offs, n)
            own = signed(found) == node[i:j]  # another text under the same id is left out
            self.held.append((node[i:j][own], weight[i:j][own], block[i:j][own], size[own], g[np.repeat(own, size)]))

    def links(self, t: float) -> pa.RecordBatch:
        """Each node, the weight of the nodes linked to it, and the least node of those that links join."""
        node, weight, block, size, member = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        _, code = np.unique(member, return_inverse=True)
        first = np.cumsum(size) - size
        _, once = np.unique(node, return_index=True)
        order = once[np.argsort(size[once], kind="stable")]
        node, weight, block, size, first = node[order], weight[order], block[order], size[order], first[order]
        count, label, total = len(node), np.arange(len(node)), np.zeros(len(node), np.int64)
        seen, words = np.zeros(int(code.max(initial=-1)) + 1, bool), _words_of(size)
        widths = {}
        for w in np.unique(words).tolist():
            lo, hi = np.searchsorted(words, w), np.searchsorted(words, w, "right")
            at = np.arange(int(size[lo:hi].sum())) + np.repeat(first[lo:hi] - (np.cumsum(size[lo:hi]) - size[lo:hi]), size[lo:hi])
            widths[w] = (lo, hi, {w: _sketches(member[at], size[lo:hi], w).reshape(-1, w)})
        last = np.searchsorted(size, size / t + 1e-9, "right")
        for p in range(count):
            w, hits = int(words[p]), []
            own = widths[w][2][w][p - widths[w][0]]
            for v, (lo, hi, folded) in widths.items():
                f, e = max(lo, p + 1), min(hi, int(last[p]))
                if v < w or f >= e:
                    continue
                if w not in folded:
                    folded[w] = np.bitwise_xor.reduce(folded[v].reshape(hi - lo, -1, w), axis=1)
                ok = np.bitwise_count(folded[w][f - lo : e - lo] ^ own).sum(axis=1, dtype=np.int64) <= limit_of(size[f:e] + size[p], t)
                if self.cross:
                    ok &= block[f:e] != block[p]
                hits.append(f + np.flatnonzero(ok))
            q = np.concatenate(hits) if hits else label[:0]
            if not len(q):
                continue
            mine = code[first[p] : first[p] + size[p]]
            seen[mine] = True
            near = []
            step = max(1, TILE // int(size[q].max()))
            for i in range(0, len(q), step):
                other = q[i : i + step]
                n = size[other]
                start = np.cumsum(n) - n
                shared = np.add.reduceat(seen[code[np.arange(int(n.sum())) + np.repeat(first[other] - start, n)]], start, dtype=np.int64)
                near.append(other[shared / (size[p] + n - shared) >= t - 1e-12])
            seen[mine] = False
            q = np.concatenate(near)
            if not len(q):
                continue
            total[p] += weight[q].sum()
            total[q] += weight[p]
            linked(label, np.r_[p, q])
        least = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        use = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(total[use]), pa.array(least[label[use]])], schema=LINKS)


def _linked(batches: Iterator[pa.RecordBatch], n: int, t: float) -> Iterator[pa.RecordBatch]:
    """Rows (comp, i, j, node, weight, block, text) ordered by comp, i and j."""
    now, group = None, None
    for b in batches:
        comp, i, j = (b.column(k).to_numpy() for k in range(3))
        cuts = [0, *(np.flatnonzero((comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1), len(comp)] if len(comp) else []
        for f, e in zip(cuts, cuts[1:], strict=False):
            if now != (comp[f], i[f], j[f]):
                if group is not None and group.held:
                    yield group.links(t)
                now, group = (comp[f], i[f], j[f]), _Group(bool(i[f] != j[f]))
            part = b.slice(f, e - f)
            group.add(part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(6), n)
    if group is not None and group.held:
        yield group.links(t)


def _joined(pairs: DataFrame, one: DataFrame, t: float) -> DataFrame:
    """Those of the pairs of nodes that their sketches' distance lets pass."""
    sides = [one.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab"]
    both = pairs.distinct().join(sides[0], "a").join(sides[1], "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
    return both.mapInArrow(partial(_near, t=t), "a bigint, b bigint")


def _components(texts: DataFrame, one: DataFrame, n: int, t: float, level: np.ndarray) -> DataFrame:
    """(node, comp): components that hold all nodes linked by candidates, and perhaps more."""
    parts = shuffle_partitions(texts.sparkSession)
    packed = texts.mapInArrow(partial(_keys, n=n, t=t, parts=parts, level=level), Blobs.DDL)
    met = written(packed.repartitionById(parts, F.col("part")).mapInArrow(partial(_met, t=t), MET_DDL), "met")
    near = written(_joined(met.where("a is not null").select("a", "b"), one, t), "near")
    comps = moved(connected_components(near), "comps", near)
    rows = met.where("a is null").select("key", "node", "size", "mark")
    if not rows.isEmpty():
        told = rows.join(small_side(comps), "node", "left").select("key", "node", "size", "mark", F.coalesce("comp", "node").alias("comp"))
        crossed = told.repartition(parts, "key").mapInArrow(partial(_crossed, t=t), "a bigint, b bigint")
        more = written(_joined(crossed, one, t), "near")
        comps = moved(connected_components(more.union(comps.select("node", "comp"))), "comps", more, comps)
    dropped(met)
    return comps


def near_classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class, links) of every id: least id of its class, and number of other documents with Jaccard >= t."""
    parts = shuffle_partitions(docs.sparkSession)
    texts = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    nodes = written(texts.mapInArrow(partial(_nodes, n=n), "id bigint, node bigint, size bigint, sketch binary"), "nodes")
    of = nodes.select("id", "node").distinct()
    weight = of.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    sketches = nodes.where("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    one = written(weight.join(sketches, "node"), "one")
    comps = _components(texts, one, n, t, levels_of(texts, nodes.count(), n))
    blocks = F.greatest(F.count("*") / BLOCK_NODES, F.sum("size") / BLOCK_MEMBERS)
    picked = written(in_blocks(comps, one.select("node", "id", "weight", "size"), blocks).drop("size"), "picked")
    met = meeting(texts.join(small_side(picked), "id")).select("comp", "i", "j", "node", "weight", "block", "text")
    found = written(met.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(partial(_linked, n=n, t=t), "node bigint, links bigint, up bigint"), "links")
    out = classes(of, one, found, not picked.where("blocks > 1").isEmpty())
    dropped(comps, picked, found, one)
    return out


def ngram_jaccard_join(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links), one row a document.

    ``links`` is the number of other documents with Jaccard >= t; chains of links make a class, named by its least id.
    A document without links is a class of its own.
    """
    return near_classes(docs, n, t, id_col, text_col).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "links")


def drop_near_duplicates(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that resemble one of a smaller id; rows repeated under one id are one document.

    Documents with a null id or without words stay. The columns of ``docs`` are returned as they are.
    """
    gone = written(near_classes(docs, n, t, id_col, text_col).where("id <> class").select(F.col("id").alias("__gone")), "gone")
    return docs.join(small_side(gone), as_long(id_col) == F.col("__gone"), "left_anti")


#: The same by brute force over shared bigrams and a walk along links, for n = 2 and t = 0.7.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(ws) = 1 THEN ws ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS grams FROM w WHERE len(ws) > 0),
n AS (SELECT row_number() OVER () AS node, grams, len(grams) AS size, ids FROM (SELECT grams, list_sort(list(DISTINCT doc_id)) AS ids FROM g GROUP BY grams)),
u AS (SELECT node, unnest(grams) AS gram FROM n),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS shared FROM u a JOIN u b ON a.gram = b.gram AND a.node < b.node GROUP BY 1, 2),
j AS (SELECT x.ids AS x, y.ids AS y FROM p JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE shared >= 0.7 * (x.size + y.size - shared) - 1e-9),
l AS (SELECT x AS ids, y AS others FROM j UNION ALL SELECT y, x FROM j UNION ALL SELECT ids, ids FROM n WHERE len(ids) > 1),
e AS (SELECT DISTINCT * FROM (SELECT doc_id, unnest(others) AS other FROM (SELECT unnest(ids) AS doc_id, others FROM l)) WHERE doc_id <> other),
r AS (SELECT DISTINCT doc_id, doc_id AS seen FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, e.other FROM r JOIN e ON e.doc_id = r.seen)
SELECT doc_id, min(seen) AS class_id, CAST(coalesce(any_value(k.links), 0) AS BIGINT) AS links FROM r LEFT JOIN (SELECT doc_id, count(*) AS links FROM e GROUP BY doc_id) k USING (doc_id) GROUP BY doc_id
"""
