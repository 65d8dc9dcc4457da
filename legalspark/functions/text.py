"""Column functions for text, labels, acts, paths and links; all are native expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"
_BASE = r"\d{5}[A-Z]\d{4}"
_CONSOLIDATED = rf"0{_BASE[:3]}4{_BASE[4:]}-\d{{8}}"


def normalize_text(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0))


def char_count(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def ends_with_colon(c: Column) -> Column:
    return F.coalesce(F.endswith(F.regexp_replace(c, r"(?U)\s+$", ""), F.lit(":")), F.lit(False))


def strip_leading_label(c: Column) -> Column:
    """struct(text, label): ``N. rest`` gives rest and N, anything else itself and null."""
    pattern = r"(?sU)^(\d+)\.\s+(.*)$"
    label = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    rest = F.regexp_replace(F.regexp_extract(c, pattern, 2), r"(?U)^\s+|\s+$", "")
    return F.struct(F.when(label.isNull(), c).otherwise(rest).alias("text"), label.alias("label"))


def normalize_label(c: Column) -> Column:
    """struct(label, kind, quoted) of an enumerator such as ``(a)``, ``12.`` or a dash."""
    c = F.trim(c)
    quoted = F.substring(c, 1, 1).isin("'", "‘", "’")
    bare = F.when(quoted, F.trim(F.regexp_replace(c, "^['‘’]", ""))).otherwise(c)
    paragraph = F.regexp_extract(bare, r"^(\d+)\.\s*", 1)
    numeric = F.regexp_extract(bare, r"^\(?(\d+)\)?[.)]?$", 1)
    letters = F.lower(F.regexp_extract(bare, r"^\(?([A-Za-z]+)\)?$", 1))
    roman = letters.rlike("^x{0,3}(ix|iv|v?i{0,3})$") & (letters != "")
    case = (
        F.when((paragraph != "") & ~F.contains(bare, F.lit("(")), F.struct(paragraph.alias("label"), F.lit("paragraph").alias("kind")))
        .when(numeric != "", F.struct(numeric.alias("label"), F.lit("numeric").alias("kind")))
        .when(roman, F.struct(letters.alias("label"), F.lit("subpoint").alias("kind")))
        .when((letters != "") & (F.length(letters) <= 2), F.struct(letters.alias("label"), F.lit("point").alias("kind")))
        .when(bare.isin("—", "–", "-"), F.struct(F.lit("—").alias("label"), F.lit("dash").alias("kind")))
        .otherwise(F.struct(bare.alias("label"), F.lit("unknown").alias("kind")))
    )
    return F.struct(case["label"].alias("label"), case["kind"].alias("kind"), quoted.alias("quoted"))


def normalize_phrase(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def looks_like_label(c: Column) -> Column:
    """Blank, a structural heading, or an enumerator of up to four characters."""
    t = F.trim(c)
    named = r"(?i)^(?:article\s+\d+[a-z]?|part\s+[a-z]|(?:annex|chapter|(?:sub-?)?section|title)\s+[ivxlc0-9]+)(?:\s+.*)?$"
    return (c == "") | t.rlike(named) | t.rlike(r"(?i)^\(?[a-zivx0-9]{1,4}\)?[.)]?$")


def strip_leading_refs(c: Column, rounds: int = 8) -> Column:
    """Without numbers, enumerators and dashes at the start, round by round until nothing changes."""

    def once(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?U)^\d+[.)]\s+", "")
        t = F.regexp_replace(t, r"(?iU)^['“”‘’]?\(?[a-z0-9]{1,4}\)?[.)]?\s+", "")
        return F.trim(F.regexp_replace(t, r"(?U)^[—–-]\s+", ""))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.trim(c), lambda t, _: once(t))


# --- acts and paths --------------------------------------------------------------------------------------------------


def act_year_number(first: Column, second: Column) -> Column:
    """struct(year, number) of the two numbers of an act, by five rules in order; null if none holds."""
    a, b = first.cast("int"), second.cast("int")

    def both(year: Column, number: Column) -> Column:
        return F.struct(year.cast("int").alias("year"), number.cast("int").alias("number"))

    return (
        F.when((a > 1900) & (a <= 2100), both(a, b))
        .when((b > 1900) & (b <= 2100), both(b, a))
        .when((a < 100) & (b < 1000), both(a + 1900, b))
        .when((b < 100) & (a >= 100), both(b + 1900, a))
        .when((a >= 1000) & (b < 1000), both(a, b))
    )


def celex(act_type: Column, year: Column, number: Column) -> Column:
    letter = F.when(act_type == "regulation", "R").when(act_type == "directive", "L").when(act_type == "decision", "D")
    return F.when(letter.isNotNull() & year.isNotNull() & number.isNotNull(), F.format_string("3%04d%s%04d", year.cast("int"), letter, number.cast("int")))


def ordinal_index(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, w in enumerate(("first", "second", "third", "fourth", "fifth"), 1):
        out = F.when(F.lower(F.trim(c)) == w, F.lit(k)).otherwise(out)
    return out


def node_id(article: Column, paragraph: Column, point: Column, subparagraph: Column, annex: Column, part: Column) -> Column:
    """Path of the parts that are there; null if none is."""
    index = ordinal_index(subparagraph)
    parts = F.concat_ws(
        ".",
        F.concat(F.lit("art-"), article),
        F.concat(F.lit("par-"), paragraph.cast("string")),
        F.when(paragraph.isNotNull(), F.concat(F.lit("subpar-"), index.cast("string"))),
        F.concat(F.lit("pt-"), F.nullif(point, F.lit(""))),
        F.concat(F.lit("annex-"), F.nullif(annex, F.lit(""))),
        F.concat(F.lit("part-"), F.nullif(part, F.lit(""))),
    )
    return F.nullif(parts, F.lit(""))


def target_path(u: dict[str, Column]) -> Column:
    """Readable path; recital before annex before article."""
    there = lambda c: F.nullif(u[c], F.lit(""))
    bracket = lambda c: F.concat(F.lit("("), c, F.lit(")"))
    paragraph = F.coalesce(there("paragraph_number"), u["paragraph_index"].cast("string"))
    labels = [bracket(there(c)) for c in ("point_label", "subpoint_label", "subsubpoint_label")]
    annex = F.concat_ws("", F.concat(F.lit("Annex "), there("annex_number")), F.concat(F.lit(", Part "), there("annex_part")))
    return (
        F.when(there("recital_number").isNotNull(), F.concat(F.lit("Recital "), there("recital_number")))
        .when(there("annex_number").isNotNull(), annex)
        .when(there("article_number").isNotNull(), F.concat_ws("", F.concat(F.lit("Art. "), there("article_number")), bracket(paragraph), *labels))
    )


# --- links, languages, CELEX numbers -----------------------------------------------------------------------------------


def file_key(celex_: Column, url: Column) -> Column:
    """The CELEX number as a file name, else 16 hexadecimal digits of the address's SHA-256."""
    return F.coalesce(F.nullif(F.translate(celex_, ":/", "__"), F.lit("")), F.left(F.sha2(url, 256), F.lit(16)))


def name_from_url(url: Column) -> Column:
    """What follows the last ``uri=``, made fit for a file name; ``document`` without one."""
    tail = F.substring_index(F.substring_index(url, "uri=", -1), "&", 1)
    plain = F.replace(F.replace(tail, F.lit("OJ:"), F.lit("")), F.lit("CELEX:"), F.lit(""))
    return F.when(F.contains(url, F.lit("uri=")), F.regexp_replace(plain, "[^A-Za-z0-9_-]", "_")).otherwise(F.lit("document"))


def language_url(url: Column, lang: Column | str) -> Column:
    return F.regexp_replace(url, F.lit("/[A-Za-z]{2}/TXT/"), F.concat(F.lit("/"), F.lit(lang) if isinstance(lang, str) else lang, F.lit("/TXT/")))


def normalize_language(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.substring_index(F.trim(c), "-", 1)), F.lit("")), F.lit("EN"))


def detect_language(html: Column) -> Column:
    """From the page's language meta tag, else its html tag, else an address in it; null if all fail."""
    first = [
        F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
        for pattern in (
            r"""(?i)<meta[^>]+name=["']WT\.z_usr_lan["'][^>]+content=["']([^"']+)["']""",
            r"""(?i)<html[^>]+\blang=["']([a-zA-Z-]{2,10})["']""",
            r"/legal-content/([A-Za-z]{2})/",
        )
    ]
    found = F.coalesce(*first)
    return F.when(found.isNotNull(), normalize_language(found))


def celex_in(c: Column) -> Column:
    """First CELEX number in a text, percent-signs decoded; null if there is none."""
    plain = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.nullif(F.upper(F.regexp_extract(plain, f"(?i)({_CONSOLIDATED}|{_BASE})", 1)), F.lit(""))


def base_celex(c: Column) -> Column:
    """Number of the act that a consolidated text goes back to; null for other numbers."""
    return F.when(c.rlike(f"^{_CONSOLIDATED}$"), F.concat(F.lit("3"), F.substring(c, 2, 9)))


def celex_candidates(explicit: Column, metas: list[Column], html: Column, source_file: Column) -> Column:
    """Distinct numbers to try, in order: given, in meta tags, in the page, in the file's name; each before its base."""
    stem = F.regexp_replace(F.regexp_replace(source_file, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    found = [celex_in(c) for c in (explicit, *metas, html, stem)]
    return F.array_distinct(F.filter(F.array(*(x for c in found for x in (c, base_celex(c)))), lambda x: x.isNotNull()))


def meta_content(html: Column, name: str) -> Column:
    """Content of a named meta tag, whichever attribute comes first."""
    quoted = name.replace(".", r"\.")
    a = F.regexp_extract(html, rf"""(?i)<meta[^>]+name=["']{quoted}["'][^>]+content=["']([^"']+)["']""", 1)
    b = F.regexp_extract(html, rf"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']{quoted}["']""", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
