"""Token counts by section, with offset-mapped attribution (operator 8).

A document is encoded once, whole. The tokens of a byte-level vocabulary tile the text's UTF-8 bytes, so running sums
of their lengths give each token's bytes, and counts of lead bytes its characters: from the character that holds its
first byte to the one after that of its last. These spans are interval-joined to the sections, runs of characters
that tile the document: a line with its line end is a section, or each of several fields with the separator after it.
A token within one section counts there. One that crosses a boundary goes by ``rule``:

    majority   to the section that holds most of its characters, of equal ones to the first (the default)
    start      to the section of its first character

so section counts always add up to the document's. A null text has no sections; an empty one has one section of no
tokens. Null and repeated ids are counted row by row, with the row's number of the section. Other columns are ignored.
Special tokens' strings are ordinary text. The vocabulary is a file of ranks whose path is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import buffers
from .shared import as_long

RULES = ("majority", "start")
_cache: dict[str, tuple] = {}


def encoder(path: str | None = None) -> tuple:
    """tiktoken encoding and the byte length of each of its tokens; kept for the life of the process."""
    import public_tokenizers
    import tiktoken

    path = str(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if path not in _cache:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            lengths[k] = len(token)
        _cache[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _cache[path]


def token_spans(text: str, raw: np.ndarray, path: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, first character and end character of each token; raw: the text's bytes."""
    coder, lengths = encoder(path)
    ids = np.array(coder.encode_ordinary(text), np.int64)
    end = np.cumsum(lengths[ids])
    start = end - lengths[ids]
    if not len(ids) or len(raw) == len(text):
        return ids, start, end
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return ids, char[start], char[end - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; section k is characters bounds[k] .. bounds[k + 1]."""
    n = len(bounds) - 1
    a = np.clip(np.searchsorted(bounds, start, "right") - 1, 0, n - 1)
    b = np.clip(np.searchsorted(bounds, end - 1, "right") - 1, 0, n - 1)
    cross = np.flatnonzero(a != b)
    where = a.copy()
    if rule == "majority":
        for k in cross:
            parts = np.minimum(bounds[a[k] + 1 : b[k] + 2], end[k]) - np.maximum(bounds[a[k] : b[k] + 1], start[k])
            where[k] = a[k] + int(np.argmax(parts))
    return np.bincount(where, minlength=n), np.bincount(where[cross], minlength=n)


SCHEMA = "doc_id bigint, section int, n_chars bigint, n_tokens bigint, n_crossing bigint"


def _counted(batches: Iterator[pa.RecordBatch], rule: str, path: str | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        valid = b.filter(b.column(1).is_valid())
        raw, offs = buffers(valid.column(1))
        out: list[list[np.ndarray]] = [[], [], [], []]
        per = []
        for k, text in enumerate(valid.column(1).to_pylist()):
            own = raw[offs[k] : offs[k + 1]]
            _, start, end = token_spans(text, own, path)
            breaks = np.flatnonzero(own == 10) + 1
            if len(own) != len(text) and len(breaks):
                breaks = np.cumsum((own & 0xC0) != 0x80)[breaks - 1]
            bounds = np.r_[0, breaks, len(text)]
            tokens, crossing = attribute(start, end, bounds, rule)
            per.append(len(tokens))
            for x, y in zip(out, (np.arange(len(tokens), dtype=np.int32), np.diff(bounds), tokens, crossing), strict=True):
                x.append(y)
        if per:
            ids = valid.column(0).take(pa.array(np.repeat(np.arange(len(per)), per)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(x)) for x in out)], names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing"])


def section_token_counts(docs: DataFrame, rule: str = "majority", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, n_chars, n_tokens, n_crossing) of each line of each document."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    return docs.select(as_long(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_counted, rule=rule, path=path), SCHEMA)


def _field_counts(batches: Iterator[pa.RecordBatch], separator: str, rule: str, path: str | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for values in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            there = [k for k, v in enumerate(values) if v is not None]
            parts = [values[k] + (separator if k != there[-1] else "") for k in there]
            text = "".join(parts)
            counts = [0] * len(values)
            if parts:
                _, start, end = token_spans(text, np.frombuffer(text.encode(), np.uint8), path)
                for k, n in zip(there, attribute(start, end, np.r_[0, np.cumsum([len(p) for p in parts])], rule)[0].tolist(), strict=True):
                    counts[k] = n
            rows.append(counts)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "tokens"])


def field_token_counts(rows: DataFrame, id_col: str, fields: list[str], separator: str = "\n", rule: str = "majority", path: str | None = None) -> DataFrame:
    """(id, tokens): for each row the tokens of each field of the fields joined by the separator; null fields have none."""
    cols = [F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields)]
    return rows.select(as_long(id_col).alias("id"), *cols).mapInArrow(partial(_field_counts, separator=separator, rule=rule, path=path), "id bigint, tokens array<bigint>")
