"""Bounded-space online packing of documents into training windows (operator 2).

Each partition keeps at most ``OPEN`` windows open. A document goes into the open window with the least room that
takes it; if none does and all are in use, the fullest is emitted and a new one opened. A document of more than a
window's capacity fills whole windows of its own first; what is left over is placed like any other. The windows still
open at the end are leftovers: they are merged, whole, best fit in falling order of size, over ``FAN`` partitions at a
time, and the emptiest ``OPEN`` of each such group go on to the next round until one group is left.

The length of a document is its count of words unless ``length_col`` names a column of lengths. Null texts, texts
without words, and lengths that are null or below 1 have nothing to place and do not appear. Null ids and repeated
rows are placed like others. Other columns are ignored; an empty table gives an empty result. Which documents share a
window depends on the partitions of the input; capacity and completeness do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import chunks, words
from .shared import as_long, dropped, small_side, written

CAPACITY, OPEN, FAN = 2048, 16, 64

PLACED = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("at", pa.int64()), ("open", pa.bool_())])
PLACED_DDL = "window bigint, doc_id bigint, start bigint, length bigint, at bigint, open boolean"


class Packer:
    """Rows (window, id, start, length, offset in the window); ``opened`` maps open windows to their fill."""

    def __init__(self, capacity: int, limit: int, first: int = 0):
        self.capacity, self.limit, self.next = capacity, limit, first
        self.opened: dict[int, int] = {}
        self.closed: list[int] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, doc: int | None, length: int) -> Iterator[tuple[int, int | None, int, int, int]]:
        start = 0
        while length - start >= self.capacity:
            self.closed.append(self.next)
            yield self.new(), doc, start, self.capacity, 0
            start += self.capacity
        left = length - start
        if left <= 0:
            return
        best, fill = None, -1
        for w, f in self.opened.items():
            if fill < f <= self.capacity - left:
                best, fill = w, f
        if best is None:
            if len(self.opened) >= self.limit:
                full = max(self.opened, key=lambda w: (self.opened[w], -w))
                del self.opened[full]
                self.closed.append(full)
            best, fill = self.new(), 0
        yield best, doc, start, left, fill
        self.opened[best] = fill + left
        if self.opened[best] == self.capacity:
            del self.opened[best]
            self.closed.append(best)


def _lengths(b: pa.RecordBatch, text: bool) -> np.ndarray:
    if not text:
        return pa.compute.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False)
    out = [np.zeros(0, np.int64)]
    for i, j, data, offs in chunks(b.column(1)):
        out.append(np.bincount(words(data, offs)[1], minlength=j - i))
    return np.concatenate(out)


def _packed(batches: Iterator[pa.RecordBatch], text: bool, capacity: int, limit: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(capacity, limit, TaskContext.get().partitionId() << 32)
    held: dict[int, list[tuple]] = {}  # rows of open windows only
    done: list[tuple] = []

    def given(rows: list[tuple], still: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + [pa.array([still] * len(rows))], schema=PLACED)

    for b in batches:
        for doc, n in zip(b.column(0).to_pylist(), _lengths(b, text).tolist(), strict=True):
            for row in packer.place(doc, n):
                held.setdefault(row[0], []).append(row)
            for w in packer.closed:
                done += held.pop(w)
            packer.closed.clear()
            if len(done) >= 20_000:
                yield given(done, False)
                done = []
    for rows, still in ((done, False), ([r for x in held.values() for r in x], True)):
        if rows:
            yield given(rows, still)


def merge(frame: pd.DataFrame, capacity: int, limit: int, last: bool) -> pd.DataFrame:
    """(window, target, base, size, open) of one group of leftovers (window, size)."""
    frame = frame.sort_values(["size", "window"], ascending=[False, True])
    fills: dict[int, int] = {}
    out = []
    for w, size in zip(frame["window"].tolist(), frame["size"].tolist(), strict=True):
        fits = [(f, -t) for t, f in fills.items() if f + size <= capacity]
        target = -max(fits)[1] if fits else w
        out.append((w, target, fills.get(target, 0)))
        fills[target] = fills.get(target, 0) + size
    keep = set() if last else set(sorted((t for t in fills if fills[t] < capacity), key=lambda t: (fills[t], t))[:limit])
    return pd.DataFrame([(w, t, base, fills[t], t in keep) for w, t, base in out], columns=["window", "target", "base", "size", "open"])


def _merger(capacity: int, limit: int, last: bool):
    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return merge(frame, capacity, limit, last).assign(grp=key[0])

    return merged


def pack(docs: DataFrame, capacity: int = CAPACITY, limit: int = OPEN, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """(window_id, doc_id, start, length, at): words start .. start + length of a document lie at ``at`` in a window."""
    what = F.col(text_col).cast("string") if length_col is None else as_long(length_col)
    rows = docs.select(as_long(id_col).alias("id"), what.alias("what")).where("what is not null")
    placed = written(rows.mapInArrow(partial(_packed, text=length_col is None, capacity=capacity, limit=limit), PLACED_DDL), "placed")
    left = placed.where("open").groupBy("window").agg(F.sum("length").alias("size"))
    groups = (placed.agg(F.max(F.shiftright("window", 32))).first()[0] or 0) + 1
    now = left.select("window", "size", F.shiftright("window", 32).alias("grp"))
    moved = None
    while True:
        groups = -(-groups // FAN)
        now = now.withColumn("grp", F.floor(F.col("grp") / FAN))
        step = written(now.groupBy("grp").applyInPandas(_merger(capacity, limit, groups == 1), "window bigint, target bigint, base bigint, size bigint, open boolean, grp bigint"), "merge")
        own = step.select("window", "target", "base")
        if moved is None:
            total = own
        else:
            then = own.select(F.col("window").alias("target"), F.col("target").alias("t2"), F.col("base").alias("b2"))
            total = moved.join(small_side(then), "target", "left").select("window", F.coalesce("t2", "target").alias("target"), (F.col("base") + F.coalesce("b2", F.lit(0))).alias("base"))
        kept = written(total, "moved")
        if moved is not None:
            dropped(moved)
        moved = kept
        if groups == 1:
            break
        now = step.where("open").select(F.col("target").alias("window"), "size", "grp").distinct()
    out = placed.join(small_side(moved), "window", "left")
    return out.select(F.coalesce("target", "window").alias("window_id"), "doc_id", "start", "length", (F.col("at") + F.coalesce("base", F.lit(0))).alias("at"))
