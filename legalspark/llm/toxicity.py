"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios (operator 3).

Features are the distinct character n-grams of 3 to 5 characters of the folded text (lower case, anything between
words as one kind of character), hashed into 2**BITS buckets. Each present feature has the value of its log-count
ratio r = log((toxic + 1) / toxic total) - log((clean + 1) / clean total), as in the NB-SVM of Wang and Manning, and a
logistic regression with an L2 penalty is fitted on these. Buckets seen in fewer than LEAST_DOCS documents or with a
ratio within CUT of 0 are left out, so ordinary wording adds nothing however long a text is.

The fit takes at most PER_CLASS toxic and twice as many clean documents, by the order of a hash of their ids; a
quarter of them is held out to set the threshold, at the middle of the gap around the best F1. Scoring covers whole texts of all
documents.

Null texts and texts without words are clean (score 0). Labels that are null or not 0 or 1, and labels of absent
documents, are left out; without both classes nothing is rejected. Repeated rows are scored each for itself. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, chunks, fold
from .shared import as_long

ORDERS, BITS, PER_CLASS = (3, 4, 5), 18, 1000
LEAST_DOCS, CUT, L2, STEPS, RATE = 5, 1.0, 1e-4, 100, 0.05
_PRIME, _ODD = U64(0x100000001B3), U64(0x9E3779B97F4A7C15)


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters as integers, 0 for a run of others, and their rows."""
    low = fold(data)
    at = np.flatnonzero((low & 0xC0) != 0x80)
    c = low[at].astype(U64)
    wide = np.flatnonzero(c >= 0xC0)
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        w = wide[(c[wide] & U64(0xFF)) >= least]
        c[w] |= low[np.minimum(at[w] + k, len(low) - 1)].astype(U64) << U64(8 * k)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(np.searchsorted(at, offs)))
    if not len(c):
        return c, row
    use = (c != 0) | np.r_[True, (c[:-1] != 0) | (row[1:] != row[:-1])]
    return c[use], row[use]


def buckets(c: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each character, and whether it lies in one row."""
    g = c + U64(1)
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            return
        g = g[:-1] * _PRIME + c[n - 1 :] + U64(1)
        if n in ORDERS:
            yield ((g + U64(n)) * _ODD >> U64(64 - BITS)).astype(np.int32), row[: len(g)] == row[n - 1 :]


def present(data: np.ndarray, offs: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket), only of buckets with a weight if weights are given; and whether a row has words."""
    c, row = characters(data, offs)
    keys = [np.zeros(0, U64)]
    for b, whole in buckets(c, row):
        use = np.flatnonzero(whole if weight is None else whole & (weight[b] != 0))
        keys.append((row[use].astype(U64) << U64(BITS)) | b[use].astype(U64))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    some = np.bincount(row[c != 0], minlength=len(offs) - 1) > 0
    return (key >> U64(BITS)).astype(np.int64), (key & U64((1 << BITS) - 1)).astype(np.int64), some


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    threshold: float  # log-odds


def log_odds(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each row; minus infinity without words."""
    row, b, some = present(data, offs, model.weight)
    return np.where(some, np.bincount(row, model.weight[b], minlength=len(some)) + model.bias, -np.inf)


def _logistic(row: np.ndarray, b: np.ndarray, r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket of the ratio-scaled features, and the bias; Adam on the full batch, classes in balance."""
    out = np.zeros(1 << BITS)
    used, col = np.unique(b, return_inverse=True)
    if not len(used):
        return out, 0.0
    scale = r[used] / np.abs(r[used]).max()
    value = scale[col]
    w, m, s = (np.zeros(len(used) + 1) for _ in range(3))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, STEPS + 1):
        z = np.bincount(row, value * w[col], minlength=len(y)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.r_[np.bincount(col, value * d[row], minlength=len(used)) + L2 * w[:-1], d.sum()]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    out[used] = w[:-1] * scale
    return out, float(w[-1])


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """None without documents of both classes."""
    y = np.array(toxic, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    held = np.zeros(len(y), bool)
    for v in (0, 1):
        if (y == v).sum() >= 8:
            held[np.flatnonzero(y == v)[::4]] = True
    column = pa.array(texts, pa.large_string())
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for i, _, data, offs in chunks(column):
        row, b, _ = present(data, offs)
        for counts, v in ((p, 1), (q, 0)):
            counts += np.bincount(b[(y[row + i] == v) & ~held[row + i]], minlength=1 << BITS)
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[(p + q - 2 < min(LEAST_DOCS, max(1, len(y) // 10))) | (np.abs(r) < CUT)] = 0
    # the texts are read again rather than kept as features, of which few are left
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, _, data, offs in chunks(column):
        row, b, _ = present(data, offs, r)
        use = ~held[row + i]
        rows.append(row[use] + i)
        found.append(b[use])
    row, b = np.concatenate(rows), np.concatenate(found)
    index = np.cumsum(~held) - 1
    weight, bias = _logistic(index[row], b, r, y[~held])
    model = Model(weight, bias, 0.0)
    test = np.flatnonzero(held) if held.any() else np.arange(len(y))
    score = np.concatenate([log_odds(model, d, o) for _, _, d, o in chunks(pa.array([texts[k] for k in test], pa.large_string()))])
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[test][order])
    f1 = np.where(np.isfinite(score[order]), 2 * hit / (np.arange(1, len(order) + 1) + hit[-1]), -1)
    k = int(np.argmax(f1))
    below = score[order[k + 1]] if k + 1 < len(order) else -np.inf
    model.threshold = float((score[order[k]] + max(below, score[order[k]] - 2)) / 2) if np.isfinite(score[order[k]]) else np.inf
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on a bounded sample: at most per_class toxic and 2 * per_class clean documents."""
    known = labels.select(as_long("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(n) for v, n in ((0, 2 * per_class), (1, per_class))]
    texts = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").toArrow()
    got = sorted(zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True))
    del rows
    return fit([text for _, text, _ in got], [y for _, _, y in got])


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The same columns with the log-odds in the place of the text."""
    for b in batches:
        out = [np.zeros(0)]
        for _, _, data, offs in chunks(b.column(1)):
            out.append(log_odds(model, data, offs))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], names=["id", "odds"])


def toxic_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity): the documents that the classifier rejects and their probability."""
    model = train(docs, labels, per_class, id_col, text_col)
    texts = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return texts.where("false").select(F.col("id").alias("doc_id"), F.lit(0.0).alias("toxicity"))
    scored = texts.mapInArrow(partial(_scored, model=model), "id bigint, odds double")
    return scored.where(F.col("odds") >= model.threshold).select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-F.col("odds")))).alias("toxicity"))


def _flags(batches: Iterator[pa.RecordBatch], model: Model, place: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        odds = [np.zeros(0)]
        for _, _, data, offs in chunks(b.column(place)):
            odds.append(log_odds(model, data, offs))
        yield b.filter(pa.array(np.concatenate(odds) < model.threshold))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, row by row: one pass, no join."""
    model = train(docs, labels, per_class, id_col, text_col)
    return docs if model is None else docs.mapInArrow(partial(_flags, model=model, place=docs.columns.index(text_col)), docs.schema)
