"""Citations: extraction in one Arrow pass over units, resolution of targets by a join.

Span offsets and the order of rules need a scan of the text that no built-in expression gives, so extraction and the
reading of each citation in its unit's context are one Arrow function. What remains is set-based: each citation's
candidate targets are looked up among the document's units and the first that exists is kept.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.citation_grammar import extract, in_context
from ..schema import CITATION
from ..sources.scratch import spread

_PAIRS = ("point_range", "article_range", "paragraph_range")
WITH_CANDIDATES = T.StructType([*CITATION.fields, T.StructField("candidates", T.ArrayType(T.StringType()))])


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdigit() else None


def cited(refs: list[list[dict[str, Any]]], kind: T.StructType = CITATION) -> pa.Array:
    """Lists of references as an Arrow column, built field by field."""
    flat = [r for x in refs for r in x]
    fields = []
    columns = zip(*map(itemgetter(*kind.names), flat), strict=True) if flat else ((),) * len(kind.names)
    for f, got in zip(kind.fields, columns, strict=True):
        if f.name in _PAIRS and any(got):
            got = [x and {"start": x[0], "end": x[1]} for x in got]
        fields.append(pa.array(got, to_arrow_type(f.dataType)) if got.count(None) < len(got) else pa.nulls(len(flat), to_arrow_type(f.dataType)))
    offsets = pa.array([0, *accumulate(map(len, refs))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=kind.names))


def read_in_context(text: str | None, amended: bool, article: str | None, number: str | None, index: int | None, annex: str | None, above: int | None) -> list[dict[str, Any]]:
    """The references of a unit's text as its place has them, with candidates for their targets."""
    refs = [] if amended or not text else extract(text)
    paragraph = _number(number)
    return in_context(refs, text or "", article, paragraph if paragraph is not None else index, annex, above) if refs else []


def _found(batches: Iterator[pa.RecordBatch], context: bool, keys: int = 2) -> Iterator[pa.RecordBatch]:
    """(keys, amended, text[, article, paragraph number, paragraph index, annex, subparagraph above]) -> keys, citations."""
    collected = gc.isenabled()
    gc.disable()  # references hold no rings, and there are many of them to search
    try:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns[keys:]), strict=True)
            out = [read_in_context(text, amended, *more) if context else [] if amended else extract(text) for amended, text, *more in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], cited(out, WITH_CANDIDATES if context else CITATION)], names=[*b.schema.names[:keys], "citations"])
    finally:
        if collected:
            gc.enable()


def extract_citations(units: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, pos, citations) without context: units(doc_id, pos, text[, is_amendment_text]); or with other ``keys``, as they are."""
    amended = F.coalesce("is_amendment_text", F.lit(False)) if "is_amendment_text" in units.columns else F.lit(False)
    known = units.select(*keys) if keys else units.select(F.col("doc_id").cast("string"), F.col("pos").cast("int"))
    rows = units.select(*(F.col(f.name).cast(f.dataType) for f in known.schema), amended.alias("amended"), F.col("text").cast("string"))
    n = len(known.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(batches, False, n)

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in known.schema), T.StructField("citations", T.ArrayType(CITATION))])
    return spread(rows).mapInArrow(run, schema)


def exploded(citations: DataFrame) -> DataFrame:
    """One row a citation: (doc_id, pos or other keys, cit_idx, fields)."""
    keys = [c for c in citations.columns if c != "citations"]
    return citations.select(*keys, F.posexplode("citations").alias("cit_idx", "c")).select(*keys, "cit_idx", "c.*")


def subparagraph_above(units: DataFrame) -> DataFrame:
    """(doc_id, id, above): index of the nearest ancestor of type subparagraph; units without one are left out.

    A path id names its ancestors, but parents may be renamed, so the tree is walked, by a recursive query that ends
    when no unit has a step left; its joins are keyed by document.
    """
    view = f"units_{uuid.uuid4().hex}"
    units.select("doc_id", "id", "type", "parent_id", "subparagraph_index").createOrReplaceTempView(view)
    return units.sparkSession.sql(
        f"""with recursive walk(doc_id, id, at, kind, idx) as (
              select u.doc_id, u.id, p.parent_id, p.type, p.subparagraph_index from {view} u join {view} p on u.doc_id = p.doc_id and u.parent_id = p.id
              union all
              select w.doc_id, w.id, p.parent_id, p.type, p.subparagraph_index from walk w join {view} p on w.doc_id = p.doc_id and w.at = p.id where w.kind <> 'subparagraph')
            select doc_id, id, idx as above from walk where kind = 'subparagraph'"""
    )


def resolve_targets(citations: DataFrame, units: DataFrame) -> DataFrame:
    """Keeps the first candidate that is a unit of the document; external targets stay as they are.

    citations: (doc_id, pos, citations with candidates); one anti-free path: explode, semi-join on (doc_id, id),
    first by place, and the array put together again with its fields replaced.
    """
    flat = citations.select("doc_id", "pos", F.posexplode_outer("citations").alias("cit_idx", "c"))
    asked = flat.where("c.citation_type = 'internal'").select("doc_id", "pos", "cit_idx", F.posexplode("c.candidates").alias("rank", "id"))
    there = asked.join(units.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi")
    first = there.groupBy("doc_id", "pos", "cit_idx").agg(F.min_by("id", "rank").alias("target"))
    joined = flat.join(first, ["doc_id", "pos", "cit_idx"], "left")
    target = F.when(F.col("c.citation_type") == "internal", F.col("target")).otherwise(F.col("c.target_node_id"))
    whole = F.struct(*(target.alias(f.name) if f.name == "target_node_id" else F.col(f"c.{f.name}") for f in CITATION.fields))
    rows = joined.select("doc_id", "pos", F.when(F.col("c").isNotNull(), F.struct("cit_idx", whole.alias("c"))).alias("r"))
    return rows.groupBy("doc_id", "pos").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["c"]).alias("citations"))


def resolved_citations(units: DataFrame) -> DataFrame:
    """(doc_id, pos, citations) of every unit, read in context and resolved.

    Units from the structure pass bring ``subparagraph_above``; for others the tree is walked.
    """
    known = "subparagraph_above" in units.columns
    rows = units.withColumnRenamed("subparagraph_above", "above") if known else units.join(subparagraph_above(units), ["doc_id", "id"], "left")
    rows = rows.select(
        "doc_id", "pos", F.coalesce("is_amendment_text", F.lit(False)).alias("amended"), "text", "article_number", "paragraph_number", "paragraph_index", "annex_number", "above"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(batches, True)

    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("citations", T.ArrayType(WITH_CANDIDATES))])
    return resolve_targets(rows.mapInArrow(run, schema), units)


def nearest_preceding(left: DataFrame, right: DataFrame, key: str, at: str, before: str, value: str) -> DataFrame:
    """As-of look-up: each left row's last ``value`` of the right rows of its key with ``before`` < ``at``.

    One union and one window, so a key's rows are shuffled once and no pairs are formed.
    """
    a = left.withColumns({"__at": F.col(at), "__side": F.lit(0), "__v": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(key, F.col(before).alias("__at"), F.lit(1).alias("__side"), F.col(value).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("preceding", F.last("__v", ignorenulls=True).over(w)).where("__side = 0").drop("__at", "__side", "__v")
