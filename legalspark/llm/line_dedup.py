"""Line de-duplication by an exact set-similarity join (operator 9).

A line is the set of its words. It goes if a line at an earlier place, by (id, line number), has a Jaccard of at
least t, whether or not that line goes itself; equal sets have Jaccard 1. Words are ordered by rarity: by the count of
their bucket in a histogram of fixed size over the whole corpus, then by hash. Any order shared by all lines keeps the
join exact, so bucket collisions cost time only. A line of s words posts its first s - ceil(t s) + 1 words (prefix
filter); postings of one word are paired under the length filter s_a >= t s_b, the positional filter (words left after
the shared one must reach the overlap needed) and the Hamming distance of parity sketches of a line's size, which
bounds the symmetric difference from below. Within a word's postings, pairs that pass are kept as a spanning forest only, so a
family of many variants costs as many edges as it has members. Connected components of these edges hold every true
pair; each component's word sets are brought together, and each line is compared exactly with all earlier ones of its
component until one resembles it. A component of more than BLOCK_LINES lines or BLOCK_BYTES of words is cut into blocks,
any two of which meet in a task, so no task holds more than two blocks, however large a family of lines is.

Null ids and null texts take no part. Lines of fewer than ``min_words`` distinct words, empty ones too, always stay.
Rows repeated under one id are one document. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, in_blocks, meeting
from .kernel import U64, Blobs, chunks, mix, runs, signed, target_of, words
from .shared import BROADCAST_ROWS, as_long, ids_of, shuffle_partitions, small_side, written

THRESHOLD, MIN_WORDS = 0.8, 1
BUCKET_BITS, RANGE_BITS = 18, 12
LINES, LEVELS, PAIRS = 1 << 16, 7, 1 << 18
_RANK_BITS, _HASH_BITS = 10, 38
BLOCK_LINES, BLOCK_BYTES = 1 << 13, 1 << 24
#: Numbers of lines to cut, ids included, up to which their lists are broadcast (8 bytes each).
BROADCAST_CUTS = 2_000_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in batches:
        for _, _, data, offs in chunks(b.column(0)):
            h = words(data, offs)[0]
            total += np.bincount((h >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
    if total.any():
        pieces = total.reshape(-1, 1 << RANGE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], schema=Blobs.SCHEMA)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(blob, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], schema=Blobs.SCHEMA)


def word_ranks(texts: DataFrame) -> np.ndarray:
    """Rank by frequency of each of 2**18 word buckets, over all texts: 0 the rarest; 512 KB at any size of input."""
    partial_ = texts.mapInArrow(_counts, Blobs.DDL)
    pieces = 1 << (BUCKET_BITS - RANGE_BITS)
    rows = partial_.repartitionById(min(pieces, shuffle_partitions(texts.sparkSession)), F.col("part")).mapInArrow(_sums, Blobs.DDL).collect()
    total = np.zeros((pieces, 1 << RANGE_BITS), np.int64)
    for r in rows:
        total[r.part] = np.frombuffer(r.blob, np.int64)
    return np.minimum(np.log2(total.ravel() + 1) * 24, (1 << _RANK_BITS) - 1).astype(np.uint16)


def needed(t: float, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Overlap that sets of a and b words need for a Jaccard of t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def line_sets(data: np.ndarray, offs: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """By runs of lines: row and number of each line; its words, rarest first; first word, size and signature."""
    breaks = np.flatnonzero(data == 10)
    per = 1 + np.searchsorted(breaks, offs[1:], "left") - np.searchsorted(breaks, offs[:-1], "left")
    starts = np.sort(np.r_[offs[:-1], breaks + 1])
    row = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    bounds = np.r_[starts, len(data)]
    h, line, _, _ = words(data, bounds)
    value = (ranks[(h >> U64(64 - BUCKET_BITS)).astype(np.int64)].astype(U64) << U64(_HASH_BITS)) | (h & U64((1 << _HASH_BITS) - 1))
    for f in range(0, len(row), LINES):
        e = min(f + LINES, len(row))
        x, y = np.searchsorted(line, (f, e))
        key = np.sort(((line[x:y] - f).astype(U64) << U64(_RANK_BITS + _HASH_BITS)) | value[x:y])
        if len(key):
            key = key[np.r_[True, key[1:] != key[:-1]]]
        of = (key >> U64(_RANK_BITS + _HASH_BITS)).astype(np.int64)
        v = key & U64((1 << (_RANK_BITS + _HASH_BITS)) - 1)
        size = np.bincount(of, minlength=e - f)
        first = np.cumsum(size) - size
        total = np.zeros(e - f, U64)
        some = size > 0
        if some.any():
            total[some] = np.add.reduceat(mix(v), first[some])
        yield row[f:e], number[f:e], v, first, size, mix(total + size.astype(U64))


def levels_of(size: np.ndarray) -> np.ndarray:
    """Sketches have 64 * 2**level bits, at least 4 / 3 a word of the line up to 4096."""
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / 48) - 1e-9), 0, LEVELS - 1).astype(np.int64)


def _sketches(v: np.ndarray, first: np.ndarray, size: np.ndarray, level: int) -> np.ndarray:
    """Parity sketches (line, 64-bit word) of the lines given by first and size."""
    wide = 1 << level
    line = np.repeat(np.arange(len(size)), size)
    own = v[np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
    out = np.zeros(len(size) * wide, U64)
    np.bitwise_xor.at(out, line * wide + ((own >> U64(6)).astype(np.int64) & (wide - 1)), U64(1) << (own & U64(63)))
    return out.reshape(-1, wide)


def _postings(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, t: float, min_words: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed places of lines, by signature (kind -1), and postings, by word (kind: level of their sketches)."""
    place, post = Blobs(parts), [Blobs(parts, (1 << 18) >> k) for k in range(LEVELS)]

    def marked(found: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
        for x in found:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(np.full(len(x), kind, np.int32))], schema=_PACKED)

    for b in batches:
        ids = b.column(0).to_numpy()
        for i, _, data, offs in chunks(b.column(1)):
            for row, number, v, first, size, sig in line_sets(data, offs, ranks):
                long = np.flatnonzero(size >= min_words)
                yield from marked(place.add(target_of(sig[long], parts), sig[long], ids[i + row[long]], number[long].astype(np.uint32)), -1)
                level = levels_of(size[long])
                for kind in np.unique(level):
                    use = long[level == kind]
                    s = size[use]
                    p = s - np.ceil(t * s - 1e-9).astype(np.int64) + 1
                    k = np.repeat(np.arange(len(use)), p)
                    pos = np.arange(len(k)) - np.repeat(np.cumsum(p) - p, p)
                    word = mix(v[first[use][k] + pos])
                    sketch = _sketches(v, first[use], s, int(kind))
                    yield from marked(post[kind].add(target_of(word, parts), (word & U64(0xFFFFFFFF)).astype(np.uint32), sig[use][k], s[k].astype(np.uint32), pos.astype(np.uint32), sketch[k]), int(kind))
    yield from marked(place.flush(), -1)
    for kind, x in enumerate(post):
        yield from marked(x.flush(), kind)


_PACKED = pa.schema([*Blobs.SCHEMA, ("kind", pa.int32())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("line", pa.int32())])
FOUND_DDL = "a bigint, b bigint, id bigint, line int"


def _matches(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Edges of signatures (a, b) that connect all pairs that pass, and places (a, id, line) of each signature."""
    post: dict[int, list[bytes]] = {}
    for b in batches:
        for blob, kind in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            post.setdefault(kind, []).append(blob)
    place = post.pop(-1, [])
    sig, ids, line = Blobs.read(place, U64, np.int64, np.uint32)
    del place
    for f in range(0, len(sig), 1 << 18):
        at = slice(f, f + (1 << 18))
        n = len(sig[at])
        yield pa.RecordBatch.from_arrays([pa.array(signed(sig[at])), pa.nulls(n, pa.int64()), pa.array(ids[at]), pa.array(line[at].astype(np.int32))], schema=FOUND)
    del sig, ids, line
    if not post:
        return
    parts, sketches = [], {}
    for kind in sorted(post):
        *own, sketch = Blobs.read(post.pop(kind), np.uint32, U64, np.uint32, np.uint32, np.dtype([("w", U64, (1 << kind,))]))
        sketches[kind] = sketch["w"]
        parts.append([*own, np.full(len(sketch), kind, np.int8), np.arange(len(sketch))])
    word, sig, size, pos, level, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort((word.astype(U64) << U64(32)) | size, kind="stable")
    word = word[order]
    same = word[1:] == word[:-1]
    use = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    order, word = order[use], word[use]
    again = np.lexsort((sig[order], (word.astype(U64) << U64(32)) | size[order]))
    order, word = order[again], word[again]
    sig, size, pos, level, at = (x[order] for x in (sig, size.astype(np.int64), pos.astype(np.int64), level, at))
    new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (sig[1:] != sig[:-1])][: len(word)])
    word, sig, size, pos, level, at = (x[new] for x in (word, sig, size, pos, level, at))

    def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Hamming distance of the sketches; the longer ones are folded."""
        out = np.zeros(len(p), np.int64)
        for a, b in np.unique(np.stack([level[p], level[q]]), axis=1).T:
            mine = np.flatnonzero((level[p] == a) & (level[q] == b))
            x, y = sketches[a][at[p[mine]]], sketches[b][at[q[mine]]]
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[mine] = np.bitwise_count(x ^ y).sum(axis=1)
        return out

    out: list[np.ndarray] = []
    label = np.arange(len(word))  # of connected postings; every step down is an edge that is kept

    def roots(x: np.ndarray) -> np.ndarray:
        x = label[x]
        while not np.array_equal(y := label[x], x):
            x = y
        return x

    first, count = runs(word)
    run = np.repeat(np.arange(len(first), dtype=np.int64), count) << 32
    rest = (size - pos).astype(np.float32)
    # in a run, sorted by size, the partners of a posting are those after it up to the greatest size the length filter allows
    partners = np.searchsorted(run | size, run | np.floor(size / t + 1e-6).astype(np.int64), "right") - np.arange(len(word)) - 1
    total = np.r_[0, np.cumsum(partners)]
    share = np.float32(t / (1 + t))
    f = 0
    while f < len(word):
        e = max(f + 1, int(np.searchsorted(total, total[f] + PAIRS, "right")) - 1)
        n = partners[f:e]
        p = np.repeat(np.arange(f, e), n)
        q = p + 1 + np.arange(len(p)) - np.repeat(total[f:e] - total[f], n)
        f = e
        # the margins let a few more pairs through; whole sets are compared later
        good = np.flatnonzero(np.minimum(rest[p], rest[q]) >= share * (size[p] + size[q]).astype(np.float32) - np.float32(1e-2))
        p, q = p[good], q[good]
        x, y = roots(p), roots(q)
        apart = np.flatnonzero(x != y)
        p, q = p[apart], q[apart]
        apart = apart[distance(p, q) <= size[p] + size[q] - 2 * needed(t, size[p], size[q])]
        x, y = x[apart], y[apart]
        while len(x):  # each root is hooked to a lower one once at most: the edges are a forest
            x, y = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, y, x)
            hooked = np.unique(y)
            out.append(np.stack([label[hooked], hooked]))
            x, y = roots(x), roots(y)
            apart = x != y
            x, y = x[apart], y[apart]
    if out:
        a, b = (sig[x] for x in np.concatenate(out, axis=1))
        a, b = signed(np.minimum(a, b)), signed(np.maximum(a, b))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())], schema=FOUND)


SETS = pa.schema([("sig", pa.int64()), ("words", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, wanted: np.ndarray | None, min_words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, offs in chunks(b.column(1)):
            for _, _, v, first, size, sig in line_sets(data, offs, ranks):
                s = signed(sig)
                use = size >= min_words
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)
                    use &= wanted[at] == s
                use = np.flatnonzero(use)
                yield pa.RecordBatch.from_arrays([pa.array(s[use]), pa.array([v[first[k] : first[k] + size[k]].tobytes() for k in use], pa.binary())], schema=SETS)


def earliest(words_: list[np.ndarray], t: float) -> np.ndarray:
    """For each of the sets, in order, the first earlier one of Jaccard >= t, else -1."""
    n = len(words_)
    size = np.array([len(w) for w in words_])
    found = np.full(n, -1)
    if n == 2:
        both = np.sort(np.concatenate(words_))
        shared = int((both[1:] == both[:-1]).sum())
        if shared >= t * (len(both) - shared) - 1e-9:
            found[1] = 0
        return found
    values, token = np.unique(np.concatenate(words_), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    first = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(values), bool)
    for k in range(n - 1):
        mine = token[first[k] : first[k + 1]]
        use = owner > k
        owner, token_left = owner[use], token_left[use] if k else token[use]
        if not len(owner):
            break
        mark[mine] = True
        shared = np.bincount(owner[mark[token_left]], minlength=n)
        mark[mine] = False
        hit = np.flatnonzero((shared > 0) & (shared >= t * (size + size[k] - shared) - 1e-9))
        if len(hit):
            found[hit] = k
            use = found[owner] < 0
            owner, token_left = owner[use], token_left[use]
    return found


KEPT_DDL = "sig bigint, kept struct<id: bigint, line: int>"
_KEPT = pa.schema([("sig", pa.int64()), ("kept", pa.struct([("id", pa.int64()), ("line", pa.int32())]))])


def _compared(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Rows (comp, i, j, id, line, sig, words) ordered by component, pair of blocks and place."""
    group, held, out = None, [], []

    def done() -> None:
        found = earliest([np.frombuffer(r[3], U64) for r in held], t)
        for k in np.flatnonzero(found >= 0):
            out.append((held[k][2], {"id": held[found[k]][0], "line": held[found[k]][1]}))

    for b in batches:
        for *at, id_, line, sig, words_ in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if at != group and held:
                done()
                held = []
            group = at
            held.append((id_, line, sig, words_))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _KEPT, strict=True)], schema=_KEPT)
            out = []
    if held:
        done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _KEPT, strict=True)], schema=_KEPT)


def similar_lines(docs: DataFrame, t: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no): each line to remove and the earliest line that resembles it."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    texts = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    ranks = word_ranks(texts.select("text"))
    packed = texts.mapInArrow(partial(_postings, ranks=ranks, t=t, min_words=min_words, parts=parts), Blobs.DDL + ", kind int")
    found = written(packed.repartitionById(parts, F.col("part")).mapInArrow(partial(_matches, t=t), FOUND_DDL), "lines")
    comps = written(connected_components(found.where("b is not null").select("a", "b")), "comps").withColumnRenamed("node", "sig")
    places = found.where("b is null").select(F.col("a").alias("sig"), "id", "line")
    firsts = places.groupBy("sig").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    members = written(firsts.join(comps, "sig").select("sig", "comp", "first"), "members")
    count = members.count()
    wanted = ids_of(members, "sig") if 0 < count <= BROADCAST_ROWS else None
    holders = members.select(F.col("first.id").alias("id")).distinct()
    some = texts.join(small_side(holders, count), "id", "left_semi").select("id", "text")
    sets = written(some.mapInArrow(partial(_sets, ranks=ranks, wanted=wanted, min_words=min_words), "sig bigint, words binary").dropDuplicates(["sig"]), "sets")
    one = members.join(sets.select("sig", F.length("words").alias("size")), "sig").select(F.col("sig").alias("node"), "first", "size")
    blocks = F.greatest(F.count("*") / BLOCK_LINES, F.sum("size") / BLOCK_BYTES)
    placed = written(in_blocks(members.select(F.col("sig").alias("node"), "comp"), one, blocks).drop("size"), "blocks")
    rows = meeting(placed.withColumnRenamed("node", "sig").join(sets, "sig")).select("comp", "i", "j", F.col("first.id").alias("id"), F.col("first.line").alias("line"), "sig", "words")
    near = rows.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id", "line").mapInArrow(partial(_compared, t=t), KEPT_DDL)
    near = near.groupBy("sig").agg(F.min("kept").alias("theirs"))
    kept = firsts.join(near, "sig", "left").where("n > 1 or theirs is not null").select("sig", F.least("first", "theirs").alias("kept"))
    out = places.join(kept, "sig").where(F.struct("id", "line") > F.col("kept")).distinct()
    return out.select(F.col("id").alias("doc_id"), F.col("line").alias("line_no"), F.col("kept.id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line_no"))


def drop_similar_lines(docs: DataFrame, t: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with those lines cut out; n_chars, if there, is counted again. Every document stays."""
    gone = written(similar_lines(docs, t, min_words, id_col, text_col).groupBy("doc_id").agg(F.collect_list("line_no").alias("__gone")).withColumnRenamed("doc_id", "__id"), "gone")
    lines = F.split(F.col(text_col), "\n", -1)
    flags = F.map_from_arrays("__gone", "__gone")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.map_contains_key(flags, i)), "\n")
    held = gone.agg(F.coalesce(F.sum(F.size("__gone") + 2), F.lit(0)).cast("bigint")).first()[0]
    joined = docs.join(small_side(gone, held, BROADCAST_CUTS), as_long(id_col) == F.col("__id"), "left")
    new = {text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left)}
    kinds = dict(docs.dtypes)
    out = joined.withColumns(new)
    if "n_chars" in kinds and "n_chars" not in (id_col, text_col):
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(kinds["n_chars"])))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
