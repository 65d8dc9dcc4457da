"""Language identification by unigrams over pieces, all segmentations summed (operator 10).

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a text is the product
of those of its words, and that of a word is the sum over every way to cut it into pieces, by the forward algorithm:

    alpha(0) = 1, alpha(j) = sum over pieces w[i:j] of alpha(i) p(w[i:j])

The language of the greatest log-probability wins. Pieces are compared as UTF-8 bytes, with one byte for the mark at
a word's start; every single byte is a piece too (the vocabulary's byte fallback), so no text has probability 0.
Piece probabilities are fitted by expectation maximisation (forward-backward) on a bounded sample of labelled
documents, PER_LANG of each of the LANGS commonest labels by the order of a hash of their ids. Words are runs between
ASCII white space, of any length. Words so long or rare that their probability could leave the range of a double are
worked out in logarithms, others as they are. Scoring covers whole texts of all documents.

A word's log-probabilities do not depend on where it stands, so each distinct word is scored once a task and looked
up after that. Null or blank texts have the language ``und`` and null scores. Rows with null or repeated ids are
scored each for itself; labels that are null are left out of the fit; without labels all is ``und``. Ties go to the
language first in alphabetical order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import U64, _spans_hashed, chunks, mix
from .shared import as_long, small_side

PER_LANG, LANGS, STEPS, CACHED, SMOOTH = 300, 200, 4, 400_000, 0.05
#: Words and places of a group that is worked on at once; logarithms from EXPONENT on.
GROUP_WORDS, GROUP_PLACES, EXPONENT = 20_000, 1 << 20, 690.0
MARK = 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0]] = True


def vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces as bytes, the word mark as one byte; 256 single bytes first. Control pieces and inner marks are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    out = {bytes([k]): None for k in range(256)}
    for k in range(model.vocab_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k)
        if "▁" not in piece[1:]:
            out[piece.replace("▁", chr(MARK)).encode()] = None
    return list(out)


def _hash_spans(flat: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(_spans_hashed(flat, s, e) + (e - s).astype(U64))


@dataclass
class Pieces:
    """Hash lookup of the pieces, by open addressing in arrays."""

    pieces: list[bytes]
    longest: int = 0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def __post_init__(self) -> None:
        flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        e = np.cumsum([len(p) for p in self.pieces])
        s = np.r_[0, e[:-1]]
        h = _hash_spans(flat, s, e)
        self.longest = max(map(len, self.pieces))
        self.bits = 18
        self.keys, self.rows = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
        for row, key in enumerate(h.tolist()):
            at = key >> (64 - self.bits)
            while self.rows[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.rows[at] = key, row

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of the pieces of these hashes, -1 where there is none."""
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.rows[at], -1)
        todo = np.flatnonzero((self.rows[at] >= 0) & (out < 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[todo]] == h[todo]
            out[todo[hit]] = self.rows[at[todo[hit]]]
            todo = todo[~hit & (self.rows[at[todo]] >= 0)]
        return out


def lattice(pieces: Pieces, flat: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, start and end (from the word's start) and piece of every piece within the words."""
    out = []
    lens = e - s
    for n in range(1, pieces.longest + 1):
        per = np.maximum(lens - n + 1, 0)
        w = np.repeat(np.arange(len(s)), per)
        if not len(w):
            break
        i = np.arange(len(w)) - np.repeat(np.cumsum(per) - per, per)
        at = s[w] + i
        row = pieces.find(_hash_spans(flat, at, at + n))
        use = np.flatnonzero(row >= 0)
        out.append((w[use], i[use], i[use] + n, row[use]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def logs_needed(lens: np.ndarray, p: np.ndarray) -> bool:
    """Whether the product of single bytes could underflow for a word of these lengths."""
    return bool(-np.log(p.min()) * int(lens.max()) > EXPONENT)


def forward(edges: tuple[np.ndarray, ...], lens: np.ndarray, p: np.ndarray, logs: bool = False) -> np.ndarray:
    """alpha (word, place, language); with ``logs`` p and alpha are logarithms."""
    w, i, j, row = edges
    alpha = np.full((len(lens), int(lens.max()) + 1, p.shape[1]), -np.inf if logs else 0.0)
    alpha[:, 0] = 0.0 if logs else 1.0
    order = np.lexsort((w, j))
    w, i, j, row = w[order], i[order], j[order], row[order]
    cuts = np.searchsorted(j, np.arange(alpha.shape[1] + 1))
    for place in range(1, alpha.shape[1]):
        a, b = cuts[place], cuts[place + 1]
        if a == b:
            continue
        first = np.flatnonzero(np.r_[True, w[a + 1 : b] != w[a : b - 1]])
        if logs:
            alpha[w[a:b][first], place] = np.logaddexp.reduceat(alpha[w[a:b], i[a:b]] + p[row[a:b]], first, axis=0)
        else:
            alpha[w[a:b][first], place] = np.add.reduceat(alpha[w[a:b], i[a:b]] * p[row[a:b]], first, axis=0)
    return alpha


def backward(edges: tuple[np.ndarray, ...], lens: np.ndarray, p: np.ndarray, logs: bool = False) -> np.ndarray:
    """beta (word, place, language), the same from the end."""
    w, i, j, row = edges
    beta = np.full((len(lens), int(lens.max()) + 1, p.shape[1]), -np.inf if logs else 0.0)
    beta[np.arange(len(lens)), lens] = 0.0 if logs else 1.0
    order = np.lexsort((w, i))
    w, i, j, row = w[order], i[order], j[order], row[order]
    cuts = np.searchsorted(i, np.arange(beta.shape[1] + 1))
    for place in range(beta.shape[1] - 1, -1, -1):
        a, b = cuts[place], cuts[place + 1]
        if a == b:
            continue
        first = np.flatnonzero(np.r_[True, w[a + 1 : b] != w[a : b - 1]])
        if logs:
            beta[w[a:b][first], place] = np.logaddexp.reduceat(beta[w[a:b], j[a:b]] + p[row[a:b]], first, axis=0)
        else:
            beta[w[a:b][first], place] = np.add.reduceat(beta[w[a:b], j[a:b]] * p[row[a:b]], first, axis=0)
    return beta


def groups_of(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Words by length, in groups of bounded size; a longer word is a group of its own."""
    order = np.argsort(lens, kind="stable")
    f = 0
    while f < len(order):
        places = (lens[order[f : f + GROUP_WORDS]] + 1) * np.arange(1, len(order[f : f + GROUP_WORDS]) + 1)
        n = max(1, int(np.searchsorted(places, GROUP_PLACES, "right")))
        yield order[f : f + n]
        f += n


def log_probability(pieces: Pieces, flat: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(word, language) log of the sum over all segmentations."""
    lens = e - s
    out = np.zeros((len(s), p.shape[1]))
    for k in groups_of(lens):
        logs = logs_needed(lens[k], p)
        alpha = forward(lattice(pieces, flat, s[k], e[k]), lens[k], np.log(p) if logs else p, logs)
        last = alpha[np.arange(len(k)), lens[k]]
        out[k] = last if logs else np.log(last)
    return out


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a mark before each word; first and end byte of each word, the mark's included; its row."""
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    bounds = offs[:-1][offs[:-1] < len(data)]
    start[bounds] = ~space[bounds]
    at = np.flatnonzero(start)
    row = np.searchsorted(offs, at, "right") - 1
    stop = ~space
    stop[:-1] &= space[1:] | start[1:]
    end = np.flatnonzero(stop) + 1
    # the byte before a word holds the mark: room is made in a copy
    shift = np.arange(1, len(at) + 1)
    flat = np.full(len(data) + len(at), MARK, np.uint8)
    moved = np.cumsum(start)
    flat[np.arange(len(data)) + moved] = data
    s, e = at + shift - 1, end + shift
    flat[s] = MARK
    return flat, s, e, row


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    p: np.ndarray


def _word_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct spans (bytes, first, end) and counts."""
    count: dict[bytes, int] = {}
    for _, _, data, offs in chunks(pa.array(texts, pa.large_string())):
        flat, s, e, _ = spans(data, offs)
        raw = flat.tobytes()
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            w = raw[a:b]
            count[w] = count.get(w, 0) + 1
    e = np.cumsum([len(w) for w in count]).astype(np.int64)
    return np.frombuffer(b"".join(count), np.uint8), e - np.array([len(w) for w in count], np.int64), e, np.array(list(count.values()), float)


def fit(texts: dict[str, list[str]], path: str | None = None, steps: int = STEPS) -> Model:
    """Piece probabilities of each language by expectation maximisation, from uniform ones over the pieces seen."""
    pieces = Pieces(vocabulary(path))
    langs = sorted(k for k, v in texts.items() if any(t.split() for t in v))
    p = np.zeros((len(pieces.pieces), max(1, len(langs))))
    for k, lang in enumerate(langs):
        flat, s, e, count = _word_counts(texts[lang])
        q = np.full((len(pieces.pieces), 1), 1.0 / len(pieces.pieces))
        groups = [(lattice(pieces, flat, s[w], e[w]), (e - s)[w], count[w]) for w in groups_of(e - s)]
        for _ in range(steps):
            seen = np.zeros(len(q))
            for edges, lens, c in groups:
                logs = logs_needed(lens, q)
                by = np.log(q) if logs else q
                alpha, beta = forward(edges, lens, by, logs), backward(edges, lens, by, logs)
                total = alpha[np.arange(len(lens)), lens, 0]
                w, i, j, row = edges
                if logs:
                    gain = np.exp(alpha[w, i, 0] + by[row, 0] + beta[w, j, 0] - total[w]) * c[w]
                else:
                    gain = alpha[w, i, 0] * q[row, 0] * beta[w, j, 0] / total[w] * c[w]
                seen += np.bincount(row, gain, minlength=len(q))
            q = ((seen + SMOOTH) / (seen + SMOOTH).sum())[:, None]
        p[:, k] = q[:, 0]
    return Model(langs, pieces.pieces, p)


class Scorer:
    """Log-probabilities of texts; words seen are kept, up to CACHED of them."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.pieces)
        self.clear()

    def clear(self) -> None:
        self.known, self.value = np.zeros(0, U64), np.zeros((0, max(1, len(self.model.langs))), np.float32)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows = len(offs) - 1
        out = np.full((rows, self.value.shape[1]), np.nan)
        if not len(data):
            return out
        flat, s, e, row = spans(data, offs)
        if not len(s):
            return out
        h, first, inverse = np.unique(_hash_spans(flat, s, e), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > CACHED:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            value = log_probability(self.pieces, flat, s[first[new]], e[first[new]], self.model.p)
            place = np.searchsorted(self.known, h[new])
            self.known = np.insert(self.known, place, h[new])
            self.value = np.insert(self.value, place, value.astype(np.float32), axis=0)
            at = np.searchsorted(self.known, h)
        score = self.value[at]
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(row, score[inverse, k].astype(float), minlength=rows)
        out[np.bincount(row, minlength=rows) == 0] = np.nan
        return out


def _identified(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    names = np.array([*model.langs, "und"], object)
    for b in batches:
        for i, j, data, offs in chunks(b.column(1)):
            score = scorer(data, offs)
            none = np.isnan(score[:, 0]) | (not model.langs)
            filled = np.where(none[:, None], 0.0, score)
            best = filled.argmax(axis=1)
            top = filled.max(axis=1)
            rest = np.sort(filled, axis=1)[:, -2] if filled.shape[1] > 1 else top
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(names[np.where(none, len(model.langs), best)], pa.string()), pa.array(top, mask=none), pa.array(top - rest, mask=none)],
                names=["doc_id", "language", "log_probability", "margin"],
            )


def train(docs: DataFrame, per_lang: int = PER_LANG, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a bounded sample: per_lang labelled documents of each of the LANGS commonest languages."""
    rows = docs.select(as_long(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and lang <> ''").distinct()
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).select("lang")
    picked = rows.join(F.broadcast(common), "lang").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("k") <= per_lang).select("id", "lang")
    texts = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sample = texts.join(small_side(picked, per_lang * LANGS), "id").orderBy("lang", "id", "text").select("lang", "text").toArrow().to_pydict()
    out: dict[str, list[str]] = {}
    for lang, text in zip(sample["lang"], sample["text"], strict=True):
        out.setdefault(lang, []).append(text)
    return fit(out, path)


def identify(docs: DataFrame, per_lang: int = PER_LANG, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, language, log_probability, margin over the next language) of every row."""
    model = model or train(docs, per_lang, path, id_col, text_col, lang_col)
    texts = docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(partial(_identified, model=model), "doc_id bigint, language string, log_probability double, margin double")
