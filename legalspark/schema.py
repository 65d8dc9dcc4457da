"""Schemas of the tables."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def _typed(spec: str, **kinds: T.DataType) -> T.StructType:
    """Fields of a line such as ``a b:i``; s is a string, the default, i an integer, b a boolean."""
    kinds = {"s": _S, "i": _I, "b": _B} | kinds
    return _struct(*((n, kinds[k or "s"]) for n, _, k in (x.partition(":") for x in spec.split())))


_INTS, _STRINGS = _struct(("start", _I), ("end", _I)), _struct(("start", _S), ("end", _S))

CITATION = _typed(
    """
    raw_text citation_type span_start:i span_end:i article:i article_label
    paragraph:i point point_range:strings article_range:ints paragraph_range:ints subparagraph_ordinal
    subparagraph_index:i chapter section title_ref annex annex_part
    treaty_code connective_phrase target_node_id act_year:i act_type act_number
    celex
    """,
    strings=_STRINGS, ints=_INTS, list=T.ArrayType(_S),
)

#: What the structure pass gives for each unit: ``pos`` is its place in the document, ``subparagraph_above`` the index
#: of the nearest subparagraph among its ancestors.
RAW_UNIT = _typed(
    """
    pos:i id type ref text parent_id
    source_id source_file article_number paragraph_number paragraph_index:i subparagraph_index:i
    point_label subpoint_label subsubpoint_label extra_labels:list heading annex_number
    annex_part recital_number is_amendment_text:b subparagraph_above:i
    """,
    strings=_STRINGS, ints=_INTS, list=T.ArrayType(_S),
)

#: Columns of a finished unit, in the order of the output.
UNIT_COLUMNS = tuple(
    """
    id type ref text parent_id source_id source_file
    article_number paragraph_number paragraph_index subparagraph_index point_label subpoint_label subsubpoint_label
    extra_labels heading annex_number annex_part recital_number is_amendment_text source_xpath
    target_path article_heading children_count is_leaf is_stem word_count char_count
    citations
    """.split()
)

LINKS = _struct(("url", _S), ("celex", _S), ("title", _S), ("category_hint", _S), ("source", _S))
SECTION = _struct(("heading", _S), ("content", _S))
SUMMARY = _struct(("celex", _S), ("language", _S), ("title", _S), ("sections", T.ArrayType(SECTION)), ("source_url", _S), ("canonical_url", _S), ("last_modified_text", _S), ("last_modified_date", _S))
SUMMARY_STATUSES = ("ok", "disabled", "not_found", "fetch_error", "celex_missing")

VALIDATION = _struct(
    ("doc_id", _S), ("counts_parsed", T.MapType(_S, _I)), ("counts_expected", T.MapType(_S, _I)), ("orphans", T.ArrayType(_struct(("id", _S), ("parent_id", _S)))),
    ("sequence_gaps", T.ArrayType(_struct(("type", _S), ("missing", T.ArrayType(_I))))), ("is_valid", _B),
)
METADATA = _struct(
    ("title", _S), ("total_units", _I), ("total_articles", _I), ("total_paragraphs", _I), ("total_points", _I), ("total_definitions", _I), ("has_annexes", _B), ("amendment_articles", T.ArrayType(_S)),
)
UNIT = T.StructType(
    [T.StructField(n, dict((f.name, f.dataType) for f in RAW_UNIT.fields).get(n) or {"children_count": _I, "word_count": _I, "char_count": _I, "is_leaf": _B, "is_stem": _B, "citations": T.ArrayType(CITATION)}.get(n, _S)) for n in UNIT_COLUMNS]
)

#: What the fields mean, and values that are fixed; see ``described``.
MEANINGS = {
    "Unit.id": "Path of the unit in its document, unique there", "Unit.type": "Kind of unit", "Unit.ref": "Label as printed", "Unit.text": "Text with white space normalised", "Unit.parent_id": "Path of the unit above",
    "Unit.source_id": "Id of the HTML element", "Unit.source_file": "File or address of the HTML", "Unit.target_path": "Citation form of the path", "Unit.article_heading": "Heading of the article that the unit stands in",
    "Unit.is_amendment_text": "Whether the text is that of another act, as changed by this one", "Unit.children_count": "Units directly below", "Unit.is_leaf": "Whether none is below", "Unit.is_stem": "Whether it leads up to units below, with a colon",
    "Unit.word_count": "Words of the text", "Unit.char_count": "Characters of the text", "Unit.citations": "References in the text, in their order",
    "Citation.raw_text": "The reference as the text has it", "Citation.citation_type": "Whether it points into the same act or to another", "Citation.span_start": "First character of the reference in the text", "Citation.span_end": "Character after its last",
    "Citation.target_node_id": "Path of the unit it points to; of an internal one, only if there is such a unit", "Citation.celex": "CELEX number of the act it points to", "Citation.connective_phrase": "Phrase that leads up to the reference",
    "DocumentMetadata.amendment_articles": "Articles that change other acts, in their order", "DocumentMetadata.total_definitions": "Points in articles that define terms",
    "ValidationReport.counts_expected": "Elements in the HTML, by kind", "ValidationReport.counts_parsed": "Units, by type", "ValidationReport.is_valid": "Whether there are no orphans and no gaps",
}
FIXED = {"Citation.citation_type": ["internal", "eu_legislation"], "Citation.act_type": ["regulation", "directive", "decision", None]}
#: Never null in a payload.
REQUIRED = {"Unit.id", "Unit.type", "Unit.text", "Unit.is_amendment_text", "Unit.citations", "Citation.raw_text", "Citation.citation_type", "Citation.span_start", "Citation.span_end", "ValidationReport.is_valid"}


def schema_field(name: str, kind: T.DataType, description: str | None = None, values: list[Any] | None = None, nullable: bool = True) -> T.StructField:
    """A field that carries its description, and the values it may have, as metadata."""
    return T.StructField(name, kind, nullable, {k: v for k, v in (("comment", description), ("enum", values)) if v is not None})


def described(kind: T.StructType, title: str) -> T.StructType:
    """The same type with what MEANINGS and FIXED say of its fields as metadata."""
    return T.StructType([schema_field(f.name, f.dataType, MEANINGS.get(f"{title}.{f.name}"), FIXED.get(f"{title}.{f.name}"), f"{title}.{f.name}" not in REQUIRED) for f in kind.fields])


MODELS = {name: described(kind, name) for name, kind in (("Citation", CITATION), ("Unit", UNIT), ("DocumentMetadata", METADATA), ("SummarySection", SECTION), ("Summary", SUMMARY), ("ValidationReport", VALIDATION))}
_NAMED = {CITATION.simpleString(): "Citation", SECTION.simpleString(): "SummarySection"}
_PAIRS = {_INTS.simpleString(): "integer", _STRINGS.simpleString(): "string"}
_PRIMITIVE = {"string": "string", "integer": "integer", "long": "integer", "double": "number", "boolean": "boolean"}


def json_type(kind: T.DataType) -> dict[str, Any]:
    """JSON schema of a type; a pair of bounds is an array of two."""
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_type(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_type(kind.valueType)}
    if isinstance(kind, T.StructType):
        said = kind.simpleString()
        if said in _NAMED:
            return {"$ref": f"#/$defs/{_NAMED[said]}"}
        if said in _PAIRS:
            return {"type": "array", "prefixItems": [{"type": _PAIRS[said]}] * 2, "minItems": 2, "maxItems": 2}
        return json_object(kind)
    return {"type": _PRIMITIVE[kind.typeName()]}


def json_object(kind: T.StructType) -> dict[str, Any]:
    properties = {}
    for f in kind.fields:
        own = {"enum": f.metadata["enum"]} if "enum" in f.metadata else json_type(f.dataType)
        if f.nullable and "enum" not in own:
            own = {"anyOf": [own, {"type": "null"}]}
        properties[f.name] = own | ({"description": f.metadata["comment"]} if "comment" in f.metadata else {})
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": list(properties)}


def json_schemas() -> dict[str, dict[str, Any]]:
    """Draft 2020-12 schemas of a payload and of a row of the validation report, by file name."""
    draft = "https://json-schema.org/draft/2020-12/schema"
    defs = {n: json_object(MODELS[n]) for n in ("Citation", "Unit", "DocumentMetadata", "SummarySection", "Summary")}
    maybe = lambda n: {"anyOf": [{"$ref": f"#/$defs/{n}"}, {"type": "null"}]}
    root = {"document_metadata": maybe("DocumentMetadata"), "summary_lsu": maybe("Summary"), "summary_lsu_status": {"enum": list(SUMMARY_STATUSES)}, "units": {"type": "array", "items": {"$ref": "#/$defs/Unit"}}}
    payload = {"$schema": draft, "title": "Payload of a document", "type": "object", "additionalProperties": False, "properties": root, "required": list(root), "$defs": defs}
    return {"payload.schema.json": payload, "validation.schema.json": {"$schema": draft, "title": "Validation report of a document"} | json_object(MODELS["ValidationReport"])}


def _rendered() -> dict[str, str]:
    return {name: json.dumps(schema, ensure_ascii=False, indent=2, sort_keys=True) + "\n" for name, schema in json_schemas().items()}


def write_schemas(folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, text in _rendered().items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)


def check_schemas(folder: str) -> list[str]:
    """Names of the files that are missing or differ from what would be written."""
    stale = []
    for name, text in _rendered().items():
        path = os.path.join(folder, name)
        if not os.path.exists(path) or open(path, encoding="utf-8").read() != text:
            stale.append(name)
    return stale
