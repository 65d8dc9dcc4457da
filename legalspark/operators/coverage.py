"""Audit of extracted units against their HTML: lost, misplaced and invented text.

The HTML side is one Arrow pass that gives (doc_id, section, oracle, kind, text) rows; comparing them is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dom import Node, cell_text, is_list_table, lead_number, noteless, parse, squeezed
from ..functions.text import looks_like_label, normalize_text, strip_leading_refs
from .structure import annexes, grid_text, is_consolidated, subdivisions

_HEADS = frozenset(["oj-doc-ti", *(f"{x}title-article-norm" for x in ("", "s")), *(f"oj-{x}ti-art" for x in ("", "s")), *(f"oj-ti-grseq-{k}" for k in range(1, 11))])
_LEAST, _SHORT = 10, 5
_PARAGRAPHS, _POINTS = ("paragraph", "subparagraph", "intro"), ("point", "subpoint", "subsubpoint")


def section_of(div: Node) -> str:
    name = div.id().strip()
    if name.startswith("rct_"):
        return "recitals"
    if name.startswith("art_"):
        return f"art_{name.replace('art_', '')}"
    number = name.replace("anx_", "").strip()
    return f"annex_{number}" if number else "annex"


def is_correlation_annex(div: Node) -> bool:
    shown = [n for n in div.walk() if n.has("oj-ti-tbl", *_HEADS)] + div.all("p")[:5]
    return any("correlation table" in n.text().lower() for n in shown)


def _sections(root: Node) -> list[Node]:
    return [n for n in root.all("div", cls="eli-subdivision") if n.id().startswith(("rct_", "art_"))] + annexes(root)


def html_rows(html: str | Node | None) -> Iterator[tuple[str, str, str]]:
    """(section, kind, text). Kinds: full, line (for the naive oracle), paragraph and point (for the mirror)."""
    if not html:
        return
    root = parse(html)
    for div in _sections(root):
        key = section_of(div)
        yield key, "full", squeezed(noteless(div))
        if not (key.startswith("annex") and is_correlation_annex(div)):
            for line in div.text("\n", lambda n: n.has(*_HEADS)).splitlines():
                yield key, "line", squeezed(line)
    if is_consolidated(root):
        yield from _mirror_consolidated(root)
    else:
        yield from _mirror(root)


def _mirror(root: Node) -> Iterator[tuple[str, str, str]]:
    for div in subdivisions(root, "rct_"):
        table = div.first("table")
        if table is not None and is_list_table(table):
            for cells in (row.all("td") for row in table.all("tr")):
                if len(cells) >= 2:
                    yield "recitals", "paragraph", squeezed(noteless(cells[1]))
        else:
            yield "recitals", "paragraph", squeezed(" ".join(lead_number(noteless(p))[0] for p in div.all("p", cls="oj-normal")))
    for div in subdivisions(root, "art_"):
        key = section_of(div)
        boxes = [n for n in div.children("div") if re.fullmatch(r"\d{3}\.\d{3}", n.id())] or [div]
        for p in (p for box in boxes for p in box.children("p", cls="oj-normal")):
            yield key, "paragraph", squeezed(lead_number(noteless(p))[0])
        for table in div.all("table"):
            if not table.inside("td") and is_list_table(table):
                for cells in (row.children("td") for row in (table.child("tbody") or table).children("tr")):
                    if len(cells) >= 2:
                        yield key, "point", squeezed(cell_text(cells[1], outer_only=True))


def _mirror_consolidated(root: Node) -> Iterator[tuple[str, str, str]]:
    for div in subdivisions(root, "art_"):
        key = section_of(div)
        for k in div.children():
            if k.has("eli-title", "title-article-norm", "stitle-article-norm"):
                continue
            if k.tag == "div" and k.has("norm") and (mark := k.child("span", cls="no-parag")):
                inline = k.child("div", cls="inline-element")
                yield key, "paragraph", squeezed(grid_text(inline) if inline else k.text().replace("".join(mark.strings()), "", 1))
            elif k.tag == "p" and k.has("norm"):
                yield key, "paragraph", squeezed(k.text())
        for box in div.all("div", cls="grid-container"):
            body = box.first("div", cls="grid-list-column-2")
            for p in body.children("p", cls="norm") if body else []:
                yield key, "point", squeezed(p.text())


def naive_segments(lines: DataFrame, least: int = _LEAST) -> DataFrame:
    """Lines as segments: references at their start cut off, short ones and mere labels left out; all native."""
    return lines.withColumn("text", strip_leading_refs(normalize_text(F.col("text")))).where((F.length("text") >= least) & ~looks_like_label(F.col("text")))


def unit_sections(units: DataFrame) -> DataFrame:
    """(doc_id, section, type, text) of units that belong to a section and have text."""
    section = (
        F.when(F.col("type") == "recital", F.lit("recitals"))
        .when(F.col("annex_number").isNotNull(), F.when(F.col("annex_number") != "", F.concat(F.lit("annex_"), "annex_number")).otherwise(F.lit("annex")))
        .when(F.col("article_number").isNotNull(), F.concat(F.lit("art_"), "article_number"))
    )
    return units.select("doc_id", section.alias("section"), "type", normalize_text(F.col("text")).alias("text")).where("section is not null and text <> ''")


def compare_multisets(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, missing, extra, matched) by one full join of counts; nulls of keys and values compare equal."""
    a = left.groupBy(*keys, value).agg(F.count("*").alias("a"))
    b = right.groupBy(*keys, value).agg(F.count("*").alias("b"))
    names = [*keys, value]
    sides = [x.select(*(F.col(n).alias(f"{n}_{s}") for n in names), s) for x, s in ((a, "a"), (b, "b"))]
    on = [F.equal_null(F.col(f"{n}_a"), F.col(f"{n}_b")) for n in names]
    joined = sides[0].join(sides[1], on, "full")
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return joined.select(*(F.coalesce(f"{n}_a", f"{n}_b").alias(n) for n in names), F.greatest(x - y, F.lit(0)).alias("missing"), F.greatest(y - x, F.lit(0)).alias("extra"), F.least(x, y).alias("matched"))


def not_contained(segments: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that are part of no text of their keys; a null one is part of none.

    With keys it is an anti join on them with a containment condition. Without, a segment's words between its first and
    last space must be words of a text that holds it: the one in the fewest texts is the key of a join, whose pairs are
    then compared. Segments without such a word, a stated few, are held against all texts.
    """
    if keys:
        s, t = segments.alias("s"), texts.alias("t")
        on = F.contains(F.col("t.text"), F.col("s.text"))
        for k in keys:
            on = on & (F.col(f"s.{k}") == F.col(f"t.{k}"))
        return s.join(t, on, "left_anti")
    asked = segments.where("text is not null").select(F.col("text").alias("segment")).distinct()
    inner = asked.withColumn("w", F.split("segment", " ", -1)).select("segment", F.explode(F.array_distinct(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))).alias("word")).where("word <> ''")
    whole = texts.where("text is not null").select("text", F.xxhash64("text").alias("at"))
    placed = whole.select("at", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("word")).join(inner.select("word").distinct(), "word", "left_semi")
    rarity = placed.groupBy("word").count()
    key = inner.join(rarity, "word", "left").groupBy("segment").agg(F.min_by("word", F.struct(F.coalesce("count", F.lit(0)), "word")).alias("word"))
    met = placed.join(key, "word").select("at", "segment").distinct()
    found = met.join(whole, "at").where(F.contains("text", "segment")).select("segment")
    bare = asked.join(key, "segment", "left_anti")
    more = bare.join(whole, F.contains("text", "segment"), "left_semi")
    return segments.join(found.union(more).distinct(), F.col("text") == F.col("segment"), "left_anti")


def phantoms(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, section, text) of unit texts that are no part of their section's whole text, in the order of ``pos``."""
    texts = texts if "pos" in texts.columns else texts.withColumn("pos", F.lit(0))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    full = texts.where("kind = 'full'").groupBy("doc_id", "section").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("whole"))
    own = unit_sections(units).join(full, ["doc_id", "section"], "left")
    return own.where(~F.contains(F.coalesce("whole", F.lit("")), "text")).select("doc_id", "section", "text")


def percent(part, whole):
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(100.0))


def naive_coverage(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, total_html_segments, total_missing, coverage_pct)."""
    segments = naive_segments(texts.where("kind = 'line'")).select("doc_id", "section", "text")
    lost = not_contained(segments, unit_sections(units).select("doc_id", "section", "text"), ["doc_id", "section"]).groupBy("doc_id").agg(F.count("*").alias("total_missing"))
    total = segments.groupBy("doc_id").agg(F.count("*").alias("total_html_segments"))
    missing = F.coalesce("total_missing", F.lit(0))
    return total.join(lost, "doc_id", "left").select("doc_id", "total_html_segments", missing.alias("total_missing"), percent(F.col("total_html_segments") - missing, F.col("total_html_segments")).alias("coverage_pct"))


def mirror_comparison(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, section, kind, text, missing, extra, matched, gone, misclassified) by section and kind."""
    own = unit_sections(units).where(F.length("text") > _SHORT)
    nested = F.col("type").startswith("nested_")
    kind = F.when(F.col("type").isin("recital", *_PARAGRAPHS), F.lit("paragraph")).when(F.col("type").isin(*_POINTS) | nested, F.lit("point"))
    counted = own.withColumn("kind", kind).where("kind is not null and section not like 'annex%'")
    html = texts.where(F.col("kind").isin("paragraph", "point") & (F.length("text") > _SHORT))
    compared = compare_multisets(html, counted, ["doc_id", "section", "kind"], "text")
    anywhere = own.where(kind.isNotNull() | (F.col("type") == "unknown_unit")).where("section not like 'annex%'").select("doc_id", "section", "text").distinct().withColumn("there", F.lit(True))
    out = compared.join(anywhere, ["doc_id", "section", "text"], "left")
    placed = F.col("there").isNotNull()
    return out.select(*compared.columns, F.when(placed, 0).otherwise(F.col("missing")).cast("bigint").alias("gone"), F.when(placed, F.col("missing")).otherwise(0).cast("bigint").alias("misclassified"))


def mirror_coverage(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, total_html_segments, total_missing, gone, misclassified, coverage_pct, text_recall_pct)."""
    s = lambda c: F.sum(c).alias(c)
    sums = mirror_comparison(units, texts).groupBy("doc_id").agg(s("missing"), s("matched"), s("gone"), s("misclassified"))
    total = F.col("missing") + F.col("matched")
    return sums.select(
        "doc_id", total.alias("total_html_segments"), F.col("missing").alias("total_missing"), "gone", "misclassified", percent(total - F.col("missing"), total).alias("coverage_pct"), percent(total - F.col("gone"), total).alias("text_recall_pct")
    )

