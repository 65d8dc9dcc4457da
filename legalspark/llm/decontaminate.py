"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap (operator 7).

The index holds the test items. Each training passage, a window of words, is a query of its distinct words:

    score(item, passage) = sum over shared words of idf * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg)), divided by
    the item's score for its own words

so 1 means that the passage has every word of the item, and one threshold serves all items. Every item at or above
it is retrieved, in three steps that never lose one (WAND turned breadth-first over arrays): words whose greatest
impacts add up to less than ``SLACK`` of the threshold are non-essential; windows whose essential words cannot reach
the threshold with all of those added are skipped; for the rest the greatest impacts within blocks of items bound each
block, and only items of blocks that reach the threshold are scored.

Windows have ``WINDOW`` words and overlap by half; both double until half a window holds the longest item, so that a copied item
lies whole in one window. A document that is shorter is one window.

An item's answer is its last sentence if that has at least ``ANSWER_WORDS`` words, else its last third; the question
is the rest. A retrieved pair is kept if the passage holds at least ``OVERLAP`` of the question's distinct word
bigrams and as much of the answer's. A part of one word is compared by that word; a part without words agrees.

Null ids, null texts and texts without words match nothing, on either side; repeated rows of an id give one row; if
an item id is repeated, the texts are items of their own and the best one counts. An empty table gives an empty
result. Indexes of more than ``SHARD_ITEMS`` items are cut into shards, each broadcast in turn;
document frequencies, average length and window are those of all items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, chunks, grams, words
from .shared import as_long, small_side, written

K1, B = 1.2, 0.75
THRESHOLD, SLACK, OVERLAP = 0.5, 0.5, 0.6
WINDOW, BLOCK, ANSWER_WORDS = 128, 16, 3
SHARD_ITEMS = 20_000


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of a test item."""
    cuts = [m.end() for m in re.finditer(r"[.!?:\n]+\s+(?=\S)", text.strip())]
    text = text.strip()
    if cuts and len(text[cuts[-1] :].split()) >= ANSWER_WORDS:
        return text[: cuts[-1]], text[cuts[-1] :]
    parts = text.split()
    k = len(parts) - len(parts) // 3
    return " ".join(parts[:k]), " ".join(parts[k:])


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words and their texts."""
    h, r = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, _, data, offs in chunks(pa.array(texts, pa.large_string())):
        a, b, _, _ = words(data, offs)
        h.append(a)
        r.append(b + i)
    return np.concatenate(h), np.concatenate(r)


def _bigrams(h: np.ndarray) -> np.ndarray:
    return np.unique(grams(h, np.zeros(len(h), np.int64), 2)[0])


@dataclass
class Index:
    ids: np.ndarray
    vocabulary: np.ndarray  # sorted word hashes
    first: np.ndarray  # postings by word
    item: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # greatest impact of each word
    block_first: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    essential: np.ndarray
    rest: float
    parts: list[tuple[np.ndarray, np.ndarray, bool, bool]]  # bigrams, or the single words, of question and answer
    window: int
    threshold: float


@dataclass
class Stats:
    """What the scores need to know of all items, whatever shard they are in."""

    n: int
    vocabulary: np.ndarray
    df: np.ndarray
    words: int
    filled: int
    longest: int

    @classmethod
    def of(cls, texts: list[str]) -> Stats:
        h, r = _hashes(texts)
        vocabulary, word = np.unique(h, return_inverse=True)
        key = np.unique(word.astype(np.int64) * max(len(texts), 1) + r)
        length = np.bincount(r, minlength=len(texts))
        return cls(len(texts), vocabulary, np.bincount(key // max(len(texts), 1), minlength=len(vocabulary)), len(h), int((length > 0).sum()), int(length.max(initial=0)))

    def __add__(self, other: Stats) -> Stats:
        vocabulary, at = np.unique(np.r_[self.vocabulary, other.vocabulary], return_inverse=True)
        df = np.bincount(at, np.r_[self.df, other.df], minlength=len(vocabulary)).astype(np.int64)
        return Stats(self.n + other.n, vocabulary, df, self.words + other.words, self.filled + other.filled, max(self.longest, other.longest))


def build(ids: list[int], texts: list[str], threshold: float = THRESHOLD, window: int = WINDOW, stats: Stats | None = None) -> Index:
    h, r = _hashes(texts)
    n = len(ids)
    stats = stats or Stats.of(texts)
    vocabulary, word = np.unique(h, return_inverse=True)
    key, tf = np.unique(word.astype(np.int64) * max(n, 1) + r, return_counts=True)
    w, item = key // max(n, 1), key % max(n, 1)
    df = stats.df[np.searchsorted(stats.vocabulary, vocabulary)]
    idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))
    length = np.bincount(r, minlength=n)
    average = stats.words / stats.filled if stats.filled else 1.0
    impact = idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / average))
    own = np.bincount(item, impact, minlength=n)
    impact /= own[item]
    first = np.searchsorted(w, np.arange(len(vocabulary) + 1))
    most = np.maximum.reduceat(impact, first[:-1]) if len(impact) else impact
    blocks = int(np.ceil(n / BLOCK)) or 1
    bkey = w * blocks + item // BLOCK
    at = np.flatnonzero(np.r_[True, bkey[1:] != bkey[:-1]]) if len(bkey) else np.zeros(0, np.int64)
    block_impact = np.maximum.reduceat(impact, at) if len(at) else impact
    order = np.argsort(most, kind="stable")
    light = np.zeros(len(vocabulary), bool)
    light[order[np.cumsum(most[order]) < SLACK * threshold]] = True
    while stats.longest * 2 > window:
        window *= 2
    parts = []
    for t in texts:
        q, a = (_hashes([x])[0] for x in split_item(t))
        parts.append((q if len(q) < 2 else _bigrams(q), a if len(a) < 2 else _bigrams(a), len(q) < 2, len(a) < 2))
    return Index(np.array(ids, np.int64), vocabulary, first, item, impact, most, np.searchsorted(bkey[at] // blocks, np.arange(len(vocabulary) + 1)), bkey[at] % blocks, block_impact, ~light, float(most[light].sum()), parts, window, threshold)


def _expanded(first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its postings: index of the word in ``word``, and place of the posting."""
    n = first[word + 1] - first[word]
    k = np.repeat(np.arange(len(word)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[word][k]


def _summed(owner: np.ndarray, what: np.ndarray, width: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, inverse = np.unique(owner.astype(np.int64) * width + what, return_inverse=True)
    return key // width, key % width, np.bincount(inverse, value, minlength=len(key))


def search(ix: Index, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word, item index and score of every window that reaches the threshold; last, the windows tried."""
    none = np.zeros(0, np.int64)
    if not len(h) or not len(ix.vocabulary):
        return none, none, none, np.zeros(0), none
    at = np.minimum(np.searchsorted(ix.vocabulary, h), len(ix.vocabulary) - 1)
    known = ix.vocabulary[at] == h
    bound = np.r_[0.0, np.cumsum(np.where(known & ix.essential[at], ix.most[at], 0.0))]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    step = ix.window // 2
    per = np.maximum(1, -(-count // step) - 1)
    k = np.repeat(np.arange(len(first)), per)
    s = first[k] + step * (np.arange(len(k)) - np.repeat(np.cumsum(per) - per, per))
    e = np.minimum(s + ix.window, (first + count)[k])
    tried = np.flatnonzero(bound[e] - bound[s] + ix.rest >= ix.threshold - 1e-9)
    if not len(tried):
        return none, none, none, np.zeros(0), tried
    n = (e - s)[tried]
    owner = np.repeat(np.arange(len(tried)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + s[tried][owner]
    owner, place = owner[known[place]], place[known[place]]
    key = np.unique(owner * len(ix.vocabulary) + at[place])
    owner, word = key // len(ix.vocabulary), key % len(ix.vocabulary)
    # the exact bound, each word once
    total = np.bincount(owner, ix.most[word], minlength=len(tried))
    live = total[owner] >= ix.threshold - 1e-9
    owner, word = owner[live], word[live]
    k, p = _expanded(ix.block_first, word)
    blocks = int(np.ceil(len(ix.ids) / BLOCK)) or 1
    win, blk, most = _summed(owner[k], ix.block[p], blocks, ix.block_impact[p])
    good = np.zeros((1,), np.int64) if not len(win) else (win * blocks + blk)[most >= ix.threshold - 1e-9]
    k, p = _expanded(ix.first, word)
    mine = np.isin(owner[k] * blocks + ix.item[p] // BLOCK, good)
    win, item, score = _summed(owner[k][mine], ix.item[p[mine]], max(1, len(ix.ids)), ix.impact[p[mine]])
    hit = score >= ix.threshold - 1e-9
    return s[tried][win[hit]], e[tried][win[hit]], item[hit], score[hit], tried


def _share(part: np.ndarray, single: bool, h: np.ndarray, pairs: np.ndarray) -> float:
    if not len(part):
        return 1.0
    return float(np.isin(part, h if single else pairs).mean())


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
HITS_DDL = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def _hits(batches: Iterator[pa.RecordBatch], ix: Index, overlap: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy()
        for i, _, data, offs in chunks(b.column(1)):
            h, row, _, _ = words(data, offs)
            out = []
            for s, e, k, score in zip(*search(ix, h, row)[:4], strict=True):
                passage = h[s:e]
                pairs = _bigrams(passage)
                q, a, q1, a1 = ix.parts[k]
                x, y = _share(q, q1, passage, pairs), _share(a, a1, passage, pairs)
                if min(x, y) >= overlap - 1e-9:
                    out.append((int(ids[i + row[s]]), int(ix.ids[k]), float(score), x, y))
            if out:
                yield pa.RecordBatch.from_pydict({n: [o[j] for o in out] for j, n in enumerate(HITS.names)}, schema=HITS)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the best passage of each document and item."""
    spark = docs.sparkSession
    known = items.select(as_long("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    shards = -(-known.count() // shard_items)
    texts = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    found = []

    def shard(k: int) -> tuple[list[int], list[str]]:
        own = known if shards == 1 else known.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k)
        rows = own.orderBy("item_id", "text").toArrow()
        return rows.column(0).to_pylist(), rows.column(1).to_pylist()

    stats = reduce(Stats.__add__, (Stats.of(shard(k)[1]) for k in range(shards))) if shards > 1 else None
    for k in range(shards):
        index = build(*shard(k), threshold, stats=stats)
        found.append(texts.mapInArrow(partial(_hits, ix=index, overlap=overlap), HITS_DDL))
    if not found:
        return spark.createDataFrame([], HITS_DDL)
    # of equal scores the one with the greatest overlaps
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no test item was found; columns and other rows, null ids too, as they are."""
    gone = written(contaminated(docs, items, threshold, overlap, id_col, text_col).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(small_side(gone), as_long(id_col) == F.col("__gone"), "left_anti")
