"""Grammar of references in legal text: rules in order of priority, and what each yields.

A rule claims the spans it matches, longest first and then leftmost, unless an earlier rule took part of them. The
order of RULES is therefore part of the meaning. Patterns are put together from the fragments below; all ignore case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

from ..schema import CITATION

Ref = dict[str, Any]

FIELDS = tuple(f.name for f in CITATION.fields)
_BLANK: Ref = dict.fromkeys(FIELDS)
ORDINALS = {w: k for k, w in enumerate(("first", "second", "third", "fourth", "fifth"), 1)}
ORDINAL_OF = {k: w for w, k in ORDINALS.items()}
TYPE_LETTER = {"regulation": "R", "directive": "L", "decision": "D"}

#: Words that may lead up to a reference; the longest that ends the text before it is kept.
CONNECTIVES = tuple(
    x.strip()
    for x in (
        "acting in accordance with | approved by | as clarified in | as defined in | as laid down in | as outlined in | as provided for in | as referred to in | as set out in | by reason of | by virtue of"
        "| by way of derogation from | consistent with | contrary to | established in | established under | except where | falling within the scope of | for the purposes of | having regard to"
        "| identified under | in accordance with | in compliance with | in so far as | irrespective of | laid down in | listed in | notwithstanding | on the basis of | provided for in | pursuant to"
        "| referred to in | set out in | specified in | subject to | the procedure laid down in | to the extent that | under | within the meaning of | without prejudice to"
    ).split("|")
)
_WINDOW = 200


def _opt(*parts: str) -> str:
    return "(?:" + "".join(parts) + ")?"


def _any(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


def _w(*parts: str) -> str:
    return r"\s+".join(parts)


_LABEL, _NUMBER, _TOKEN = r"\d+[a-z]?", r"\d+", "[a-z0-9]+"
_EDGE = r"(?=\W|$)"
_COMMA = r"\s*,\s*"
_ROMAN = "[IVXLCDM]+"
_BRACKET = r"\({}\)".format


def _cap(name: str, body: str) -> str:
    return f"(?P<{name}>{body})"


def _paren(name: str, body: str = _TOKEN) -> str:
    return _BRACKET(_cap(name, body))


_ART = _w("Article", _cap("art", _LABEL))
_PAR = _opt(r"\s?", _paren("par", _NUMBER))
_IN = _opt(r"\s?", _paren("inner"))
_ORD = _cap("ord", "|".join(ORDINALS))
_TAG = _opt(_BRACKET(_any("EU", "EC", "EEC")), r"\s+") + _opt(r"No\s+")
_PAIR = r"\d{2,4}/\d+" + _opt("/[A-Z]{2,4}")
_ONE = _TAG + _PAIR
_LIST = _cap("acts", _ONE + f"(?:{_COMMA}{_ONE})*" + _opt(r"\s*,?\s*", _any("and", "or"), r"\s+", _ONE))
_KINDS = _cap("kinds", "|".join(f"{k.capitalize()}s?" for k in TYPE_LETTER))
_KIND = "|".join(k.capitalize() for k in TYPE_LETTER)
_ACT = (
    _opt(r"Council\s+") + _opt(r"Commission\s+") + _opt(_any("Delegated", "Implementing"), r"\s+") + _opt(_cap("frame", "Framework"), r"\s+")
    + _w(_cap("kind", _KIND), _TAG) + _cap("n1", r"\d{2,4}") + "/" + _cap("n2", _NUMBER) + _opt("/[A-Z]{2,4}")
)
_BLOCK = _cap("block", r"Articles?\s+" + _any(_LABEL, _BRACKET(_TOKEN), "Articles?", "points?", "and", "or", "to", "respectively", ",", r"\s") + "+?")
_AND_OR = _any("and", "or")


def _chain(item: str) -> str:
    return item + f"(?:{_COMMA}{item})*" + r"\s*" + _opt(r",\s*") + _AND_OR + r"\s+" + item


def _re(body: str) -> re.Pattern[str]:
    return re.compile(body, re.IGNORECASE)


ACT_BLOCK = _re(r"\b" + _w(_KINDS, _LIST) + r"\b")
POINT_LIST = _re("points" + r"\s+" + _chain(_BRACKET(_TOKEN)))


# --- values ------------------------------------------------------------------------------------------------------


def article_of(label: str | None) -> Ref:
    label = label.strip().lower() if label is not None else ""
    m = re.fullmatch(r"(\d+)[a-z]?", label)
    return {"article": int(m[1]), "article_label": label} if m else {}


def number_of(text: str | None) -> int | None:
    return int(text) if text is not None and text.isdigit() else None


def year_and_number(first: str, second: str) -> tuple[int, int] | None:
    """Which of the two numbers of an act is its year; two-digit years are of the last century."""
    a, b = int(first), int(second)
    for year, number in ((a, b), (b, a)):
        if 1900 < year <= 2100:
            return year, number
    if a < 100 and b < 1000:
        return 1900 + a, b
    if b < 100 <= a:
        return 1900 + b, a
    return (a, b) if a >= 1000 > b else None


@lru_cache(1 << 14)
def act_of(kind: str | None, first: str, second: str, framework: bool = False) -> Ref:
    kind = (kind or "").strip().lower()
    out: Ref = {"act_type": kind, "act_number": f"{first}/{second}"}
    if found := year_and_number(first, second):
        out["act_year"] = found[0]
        if not framework:
            out["celex"] = f"3{found[0]:04d}{TYPE_LETTER[kind]}{found[1]:04d}"
    return out


_ACT_NUMBERS = re.compile(r"(\d{2,4})/(\d+)")


def acts_of(kinds: str, acts: str) -> list[Ref]:
    kind = kinds.strip().lower().removesuffix("s")
    return [act_of(kind, a, b) for a, b in _ACT_NUMBERS.findall(acts)]


def node_of(ref: Ref) -> str | None:
    """Path of the unit that a reference names."""
    label, par, index = ref.get("article_label"), ref.get("paragraph"), ORDINALS.get(ref.get("subparagraph_ordinal") or "")
    parts = [
        f"art-{label}" if label is not None else None,
        f"par-{par}" if par is not None else None,
        f"subpar-{index}" if index and par is not None else None,
        f"pt-{ref['point']}" if ref.get("point") else None,
        f"annex-{ref['annex']}" if ref.get("annex") else None,
        f"part-{ref['annex_part']}" if ref.get("annex_part") else None,
    ]
    return ".".join(p for p in parts if p) or None


def _low(text: str | None) -> str | None:
    return text.strip().lower() if text is not None else None


def _named(m: re.Match[str]) -> dict[str, str | None]:
    return m.groupdict()


def _within(ref: Ref) -> Ref:
    return {"citation_type": "internal", **ref, "target_node_id": node_of(ref)}


def _law(ref: Ref) -> Ref:
    return {"citation_type": "eu_legislation", **ref}


# --- builders: match, text -> references ----------------------------------------------------------------------------


def _act_with_article(m: re.Match[str], text: str) -> Iterator[Ref]:
    g = _named(m)
    ref = article_of(g["art"])
    ref["paragraph"] = number_of(g["par"]) or (0 if g["par"] is not None and number_of(g["par"]) == 0 else ORDINALS.get(_low(g.get("parord")) or ""))
    ref["subparagraph_ordinal"] = _low(g.get("ord"))
    ref["point"] = _low(g.get("point") or g.get("after") or g.get("inner"))
    if g.get("from") is not None:
        ref["point_range"] = (_low(g["from"]), _low(g["upto"]))
    yield _law(ref | {"target_node_id": node_of(ref)} | act_of(g["kind"], g["n1"] or "", g["n2"] or "", bool(g["frame"])))


_ITEM = _re(f"({_LABEL})" + _opt(_BRACKET(r"(\d+)")) + _opt(_BRACKET(f"({_TOKEN})")))
_PART = _re(_ART + _PAR + _IN + _opt(_COMMA, r"point\s+\(?", _cap("after", _TOKEN), r"\)?"))


@lru_cache(1 << 12)
def _articles_of_block(block: str) -> list[Ref]:
    block = re.sub(r",\s*respectively\s*$", "", " ".join(block.split()).rstrip(","), flags=re.IGNORECASE)
    if block.lower().startswith("articles "):
        body = block[len("articles ") :].strip()
        if m := re.fullmatch(r"(\d+)\s+to\s+(\d+)", body, re.IGNORECASE):
            return [{"article_range": (int(m[1]), int(m[2]))}]
        found = _ITEM.finditer(body)
        return [article_of(m[1]) | {"paragraph": number_of(m[2]), "point": _low(m[3])} for m in found]
    found = list(_PART.finditer(block))
    out = [article_of(m["art"]) | {"paragraph": number_of(m["par"]), "point": _low(m["after"] or m["inner"])} for m in found]
    if len(found) == 1 and (more := re.fullmatch(r"\s*,?\s*(?:and|or)\s+\((\d+)\)\s*", block[found[0].end() :], re.IGNORECASE)):
        out.append({k: out[0][k] for k in ("article", "article_label")} | {"paragraph": int(more[1])})
    return out


def _product(articles: list[Ref], acts: list[Ref]) -> Iterator[Ref]:
    for article in articles:
        for act in acts:
            yield _law(article | {"target_node_id": None if "article_range" in article else node_of(article)} | act)


def _block_of_acts(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield from _product(_articles_of_block(m["block"]), acts_of(m["kinds"], m["acts"]))


def _block_of_that_act(m: re.Match[str], text: str) -> Iterator[Ref]:
    kind = m["that"].lower()
    before = [found for b in ACT_BLOCK.finditer(text[: m.start()]) if (found := acts_of(b["kinds"], b["acts"])) and found[0]["act_type"] == kind]
    if before and len(before[-1]) == 1:
        yield from _product(_articles_of_block(m["block"]), before[-1])


def _standalone(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield _law(act_of(m["kind"], m["n1"], m["n2"], bool(m["frame"])))


def _article_of_acts(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield from _product([article_of(m["art"]) | {"paragraph": number_of(m["par"]), "point": _low(m["inner"])}], acts_of(m["kinds"], m["acts"]))


def _range_of_acts(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield from _product([{"article_range": (int(m["lo"]), int(m["hi"]))}], acts_of(m["kinds"], m["acts"]))


def _treaty(code: str | None = None) -> Callable[[re.Match[str], str], Iterator[Ref]]:
    def build(m: re.Match[str], text: str) -> Iterator[Ref]:
        yield _law(article_of(m["art"]) | {"paragraph": number_of(m["par"]), "treaty_code": code or m["treaty"].upper()})

    return build


def _protocol(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield _law({"treaty_code": "PROTOCOL", "act_number": m["no"]})


def _simple(m: re.Match[str], text: str) -> Iterator[Ref]:
    """Any of article, paragraph, point, ordinal, and a range of points, in the same act."""
    g = _named(m)
    ref = article_of(g.get("art")) | {"paragraph": number_of(g.get("par")), "point": _low(g.get("point") or g.get("inner")), "subparagraph_ordinal": _low(g.get("ord"))}
    if g.get("from") is not None:
        ref["point_range"] = (_low(g["from"]), _low(g["upto"]))
    yield _within(ref)


def _article_range(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield {"citation_type": "internal", "article_range": (int(m["lo"]), int(m["hi"]))}


def _each_article(m: re.Match[str], text: str) -> Iterator[Ref]:
    for label in re.findall(r"\d+[a-z]?", m["list"]):
        yield _within(article_of(label))


def _either_article(m: re.Match[str], text: str) -> Iterator[Ref]:
    for k in "12":
        yield _within(article_of(m[f"art{k}"]) | {"paragraph": number_of(m[f"par{k}"])})


def _two_paragraphs(m: re.Match[str], text: str) -> Iterator[Ref]:
    for k in ("par", "par2"):
        yield _within(article_of(m["art"]) | {"paragraph": int(m[k])})


def _each_point(m: re.Match[str], text: str) -> Iterator[Ref]:
    for point in re.findall(r"\(([a-z0-9]+)\)", m["list"]):
        yield _within({"point": point.lower()})


def _each_paragraph(m: re.Match[str], text: str) -> Iterator[Ref]:
    for par in re.findall(r"\d+", m["list"]):
        yield _within({"paragraph": int(par)})


def _paragraph_range(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield {"citation_type": "internal", "paragraph_range": (int(m["lo"]), int(m["hi"]))}


def _two_subparagraphs(m: re.Match[str], text: str) -> Iterator[Ref]:
    for k in ("ord1", "ord2"):
        yield {"citation_type": "internal", "subparagraph_ordinal": m[k].lower()}


_DIVISIONS = {"chapter": "chapter", "section": "section", "title": "title_ref"}


def _division(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield {"citation_type": "internal", _DIVISIONS[m["division"].lower()]: (_named(m).get("roman") or "THIS").upper()}


def _annex(m: re.Match[str], text: str) -> Iterator[Ref]:
    g = {k: v.upper() if v else v for k, v in _named(m).items()}
    ref = {"annex": g["annex"], "annex_part": g.get("part")}
    yield _within(ref) | ({"section": g["letter"], "target_node_id": None} if g.get("letter") else {})


def _two_annexes(m: re.Match[str], text: str) -> Iterator[Ref]:
    for k in ("annex", "annex2"):
        yield _within({"annex": m[k].upper()})


def _relative(m: re.Match[str], text: str) -> Iterator[Ref]:
    yield {"citation_type": "internal"}


_POINTS = _w("points", _paren("from"), "to", _paren("upto"))
_POINT = _w("point", _paren("point"))
_SUB = _w("the", _ORD, "subparagraph")
_THIS = _opt(r"\s+", _w("of", "this", "Article"))
_OF_TREATY = {
    "TFEU": ("on", "the", "Functioning", "of", "the", "European", "Union"),
    "TEU": ("on", "European", "Union"),
}
_INTO = _w("", "of", "the", "")

RULES: tuple[tuple[str, re.Pattern[str], Callable[[re.Match[str], str], Iterator[Ref]]], ...] = tuple(
    (name, _re(r"\b" + body), build)
    for name, body, build in (
        ("act_point_first", _w(_POINT, "of", "") + _opt(_w("the", _ORD, "subparagraph", "of", "")) + _ART + _PAR + _IN + _w("", "of", "") + _ACT + r"\b", _act_with_article),
        ("block_acts", _w(_BLOCK, "of", _KINDS, _LIST) + r"\b", _block_of_acts),
        ("block_that_act", _w(_BLOCK, "of", "that", _cap("that", _KIND)) + r"\b", _block_of_that_act),
        ("act_article_first", _ART + _PAR + _IN + _opt(_COMMA, _w(_cap("parord", "|".join(ORDINALS)), "paragraph")) + _opt(r",\s*", _any(_w("point", _paren("after")), _POINTS)) + r"\s*,?\s*of\s+" + _ACT + r"\b", _act_with_article),
        ("article_acts", _ART + _PAR + _IN + _w("", "of", _KINDS, _LIST), _article_of_acts),
        ("range_acts", _w("Articles", _cap("lo", _NUMBER), "to", _cap("hi", _NUMBER), "of", _KINDS, _LIST), _range_of_acts),
        ("act", _ACT + r"\b", _standalone),
        ("treaty_short", _ART + _PAR + _w("", _cap("treaty", "TFEU|TEU")) + r"\b", _treaty()),
        ("treaty_tfeu", _ART + _PAR + _INTO + _w("Treaty", *_OF_TREATY["TFEU"]) + r"\b", _treaty("TFEU")),
        ("treaty_teu", _ART + _PAR + _INTO + _w("Treaty", *_OF_TREATY["TEU"]) + r"\b", _treaty("TEU")),
        ("charter", _ART + _PAR + _INTO + _w("Charter", "of", "Fundamental", "Rights") + r"\b", _treaty("CHARTER")),
        ("treaty", _ART + _PAR + _INTO + "Treaty" + _opt(_w("", "establishing", "the", "European", "Community")) + r"\b", _treaty("TREATY_GENERIC")),
        ("protocol", _w("Protocol", "No", _cap("no", _NUMBER)) + r"\b", _protocol),
        ("point_of_subparagraph", _w(_POINT, "of", _SUB) + _opt(_w("", "of", "paragraph", _cap("par", _NUMBER))) + _THIS + _EDGE, _simple),
        ("subparagraph_point", _SUB + _COMMA + _POINT + _EDGE, _simple),
        ("subparagraph_of_paragraph", _w(_SUB, "of", "paragraph", _cap("par", _NUMBER)) + _THIS + _EDGE, _simple),
        ("article_points", _ART + _PAR + _COMMA + _POINTS + _EDGE, _simple),
        ("points_of_article", _w(_POINTS, "of", _ART) + _PAR + _EDGE, _simple),
        ("article_point", _ART + _PAR + _COMMA + _POINT + _EDGE, _simple),
        ("point_of_article", _w(_POINT, "of", _ART) + _PAR + _EDGE, _simple),
        ("article_range", _w("Articles", _cap("lo", _NUMBER), "to", _cap("hi", _NUMBER)) + r"\b", _article_range),
        ("articles", _w("Articles", _cap("list", _chain(_LABEL))) + r"\b", _each_article),
        ("article_or", _w("Article", _cap("art1", _LABEL)) + _opt(r"\s?", _paren("par1", _NUMBER)) + _w("", "or", "") + _opt(r"Article\s+") + _cap("art2", _LABEL) + _opt(r"\s?", _paren("par2", _NUMBER)) + _EDGE, _either_article),
        ("article_two_paragraphs", _ART + r"\s*" + _w(_paren("par", _NUMBER), "and", _paren("par2", _NUMBER)) + _EDGE, _two_paragraphs),
        ("article", _ART + _PAR + _IN + _EDGE, _simple),
        ("points", _w("points", _cap("list", _chain(_BRACKET(_TOKEN)))), _each_point),
        ("paragraphs", _w("paragraphs", _cap("list", _chain(_NUMBER))) + r"\b", _each_paragraph),
        ("paragraph_of_this_article", _w("paragraph", _cap("par", _NUMBER), "of", "this", "Article") + r"\b", _simple),
        ("paragraph_range", _w("paragraphs?", _cap("lo", _NUMBER), _any("to", "and", "or"), _cap("hi", _NUMBER)) + r"\b", _paragraph_range),
        ("paragraph", _w("paragraph", _cap("par", _NUMBER)) + r"\b", _simple),
        ("two_subparagraphs", _w("the", _cap("ord1", "|".join(ORDINALS)), "and", _cap("ord2", "|".join(ORDINALS)), "subparagraphs", "of", "this", "paragraph") + r"\b", _two_subparagraphs),
        ("article_subparagraph", _ART + _PAR + _COMMA + _w(_ORD, "subparagraph") + r"\b", _simple),
        ("subparagraph_of_article", _w(_SUB, "of", _ART) + _PAR + r"\b", _simple),
        ("subparagraph", _SUB + r"\b", _simple),
        ("division", _w(_cap("division", "Chapter|Section|Title"), _cap("roman", _ROMAN)) + r"\b", _division),
        ("this_division", _w("this", _cap("division", "Chapter|Section|Title")) + r"\b", _division),
        ("section_of_annex", _w("Section", _cap("letter", "[A-Z]"), "of", "Annex", _cap("annex", _ROMAN)) + r"\b", _annex),
        ("annex_part", _w("Annex", _cap("annex", _ROMAN)) + r"\s*,?\s+" + _w("Part", _cap("part", "[A-Z]")) + r"\b", _annex),
        ("two_annexes", _w("Annexes", _cap("annex", _ROMAN)) + r"\s*,?\s+" + _w("and", _cap("annex2", _ROMAN)) + r"\b", _two_annexes),
        ("annex", _w("Annex(?:es)?", _cap("annex", _ROMAN)) + r"\b", _annex),
        ("relative", _any(_w("(?:this|that)", _any(_KIND, "Article", "paragraph")), "thereof") + r"\b", _relative),
    )
)


_KIND_WORDS = "|".join(TYPE_LETTER)
#: Words that a text must hold for a rule to match, of each "a|b" one.
NEEDS = {
    "act_point_first": ("point", "article", "/", _KIND_WORDS), "block_acts": ("article", "/", _KIND_WORDS), "block_that_act": ("article", "that", _KIND_WORDS),
    "act_article_first": ("article", "/", _KIND_WORDS), "article_acts": ("article", "/", _KIND_WORDS), "range_acts": ("articles", "/", _KIND_WORDS), "act": ("/", _KIND_WORDS),
    "treaty_short": ("article", "tfeu|teu"), "treaty_tfeu": ("article", "treaty", "functioning"), "treaty_teu": ("article", "treaty", "union"), "charter": ("article", "charter"), "treaty": ("article", "treaty"), "protocol": ("protocol",),
    "point_of_subparagraph": ("point", "subparagraph"), "subparagraph_point": ("point", "subparagraph"), "subparagraph_of_paragraph": ("subparagraph",),
    "article_points": ("article", "points"), "points_of_article": ("article", "points"), "article_point": ("article", "point"), "point_of_article": ("article", "point"),
    "article_range": ("articles",), "articles": ("articles",), "article_or": ("article", "or"), "article_two_paragraphs": ("article", "and"), "article": ("article",),
    "points": ("points",), "paragraphs": ("paragraphs",), "paragraph_of_this_article": ("paragraph", "article"), "paragraph_range": ("paragraph",), "paragraph": ("paragraph",),
    "two_subparagraphs": ("subparagraphs",), "article_subparagraph": ("article", "subparagraph"), "subparagraph_of_article": ("article", "subparagraph"), "subparagraph": ("subparagraph",),
    "division": ("chapter|section|title",), "this_division": ("this", "chapter|section|title"), "section_of_annex": ("section", "annex"), "annex_part": ("annex", "part"), "two_annexes": ("annexes",), "annex": ("annex",), "relative": ("this|that|thereof",),
}
_WORDS = tuple(sorted({w for need in NEEDS.values() for x in need for w in x.split("|")}))
#: Other characters that equal an ASCII letter without case.
_ALIKE = str.maketrans("İıſK", "iisk")


@lru_cache(1 << 12)
def _rules_for(there: frozenset[str]) -> tuple[tuple[re.Pattern[str], Callable[[re.Match[str], str], Iterator[Ref]]], ...]:
    return tuple((pattern, build) for name, pattern, build in RULES if all(any(w in there for w in x.split("|")) for x in NEEDS[name]))


def connective_before(text: str, start: int) -> str | None:
    """The longest known phrase that ends the text before ``start``; letters and digits only are compared."""
    before = re.sub("[^a-z0-9]+", " ", text[max(0, start - _WINDOW) : start].lower()).strip()
    return max((p for p in CONNECTIVES if before.endswith(p)), key=len, default=None)


_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)
_OTHER_DIGITS = {ord(d): "0" for d in "123456789"}
#: Forms of longer texts seldom come again and are not kept.
_KEPT = 512

Claim = tuple[re.Pattern[str], Callable[[re.Match[str], str], Iterator[Ref]], int, int, str | None]


def _claims_of(form: str) -> tuple[Claim, ...]:
    """What takes which part of a text of this form, in order of place: pattern, builder, start, end, connective phrase.

    A form is a text with every digit as 0. No rule tells one ASCII digit from another, and whether a builder yields
    anything rests on its match alone, so texts of one form have their references in the same places.
    """
    taken: list[tuple[int, int]] = []
    out = []
    low = (form if form.isascii() else form.translate(_ALIKE)).lower()
    for pattern, build in _rules_for(frozenset(w for w in _WORDS if w in low)):
        for m in sorted(pattern.finditer(form), key=lambda m: (m.start() - m.end(), m.start())):
            s, e = m.span()
            if any(s < b and a < e for a, b in taken):
                continue
            if any(True for _ in build(m, form)):
                taken.append((s, e))
                out.append((pattern, build, s, e, connective_before(form, s)))
    return tuple(sorted(out, key=lambda c: c[2]))


_kept_claims = lru_cache(1 << 14)(_claims_of)
#: References by pattern and matched text, which say all of them but where a text before the match has a say.
_kept_refs: dict[tuple[re.Pattern[str], str], list[Ref]] = {}


def _refs_at(claim: Claim, raw: str, text: str) -> list[Ref]:
    pattern, build, at = claim[:3]
    refs = [{**_BLANK, **r, "raw_text": raw} for r in build(pattern.match(text, at), text)]
    if build is not _block_of_that_act and len(raw) <= _KEPT:
        if len(_kept_refs) >= 1 << 14:
            _kept_refs.clear()
        _kept_refs[pattern, raw] = refs
    return refs


def extract(text: str | None) -> list[Ref]:
    """References in order of their start, offsets in characters; those of one match keep their order."""
    if not text:
        return []
    form = text.encode().translate(_DIGITS).decode() if text.isascii() else text.translate(_OTHER_DIGITS)
    out: list[Ref] = []
    for claim in (_kept_claims if len(form) <= _KEPT else _claims_of)(form):
        at, end, phrase = claim[2:]
        raw = text[at:end]
        for r in _kept_refs.get((claim[0], raw)) or _refs_at(claim, raw, text):
            out.append({**r, "span_start": at, "span_end": end, "connective_phrase": phrase})
    return out


# --- references seen from the unit that holds them ------------------------------------------------------------------

_BARE = {f"that {k}": k for k in TYPE_LETTER}


def _shifted(ref: Ref, point: str | None) -> str:
    """Path when the first block of a paragraph counts as the first subparagraph."""
    index = ORDINALS[ref["subparagraph_ordinal"]]
    parts = [f"art-{ref['article_label']}", f"par-{ref['paragraph']}", f"subpar-{index - 1}" if index > 1 else None, f"pt-{point}" if point else None]
    return ".".join(p for p in parts if p)


def _targets(ref: Ref, shift_first: bool) -> list[str]:
    placed = bool(ref["subparagraph_ordinal"]) and ref["article_label"] is not None and ref["paragraph"] is not None
    first = [node_of(ref), _shifted(ref, ref["point"]) if placed else None]
    out = first[::-1] if shift_first and placed else first
    if ref["point"] is not None:
        out += [node_of(ref | {"point": None}), _shifted(ref, None) if placed else None]
    if ref["annex"] is not None and ref["annex_part"] is not None:
        out.append(node_of({"annex": ref["annex"]}))
    return list(dict.fromkeys(x for x in out if x))


def in_context(refs: list[Ref], text: str, article: str | None, paragraph: int | None, annex: str | None, above: int | None) -> list[Ref]:
    """Fills in what the references leave to their unit, and lists the ``candidates`` for each target in order.

    article, paragraph, annex: the unit's own; above: index of the nearest subparagraph among the unit's ancestors.
    References are taken in order, as one may rest on those before it.
    """
    own = article_of(article)
    done: list[Ref] = []
    for source in refs:
        ref = dict(source)
        done.append(ref)
        ref["candidates"] = [ref["target_node_id"]] if ref["target_node_id"] else []
        earlier = [r for r in reversed(done[:-1]) if r["span_end"] <= ref["span_start"]]
        raw = ref["raw_text"].strip().lower()
        if ref["citation_type"] == "internal" and raw in _BARE:
            acts: dict[str, Ref] = {}
            for r in earlier:
                if r["citation_type"] == "eu_legislation" and r["act_type"] == _BARE[raw] and r["act_number"]:
                    acts.setdefault(r["act_number"], r)
            if len(acts) == 1:
                (act,) = acts.values()
                ref |= {k: act[k] for k in ("act_type", "act_number", "act_year", "celex")} | {"citation_type": "eu_legislation", "target_node_id": None, "candidates": []}
        if ref["citation_type"] == "internal":
            shift = ref["article_label"] is None
            inner = ref["point"] is not None or ref["subparagraph_ordinal"] is not None
            if own and ((shift and (inner or ref["paragraph"] is not None)) or raw in ("this article", "this paragraph")):
                ref |= own
            if ref["paragraph"] is None and (inner or raw == "this paragraph"):
                ref["paragraph"] = paragraph
            if ref["annex"] is None and ref["annex_part"] is not None:
                ref["annex"] = annex
            if ref["point"] is not None and POINT_LIST.fullmatch(ref["raw_text"].strip()):
                anchor = next((r for r in earlier if r["citation_type"] == "internal" and r["article_label"] is not None and not re.search("[.;:]", text[r["span_end"] : ref["span_start"]])), None)
                if anchor is not None:
                    ref |= {k: anchor[k] for k in ("article", "article_label", "paragraph", "subparagraph_ordinal")}
                elif above in ORDINAL_OF:
                    ref["subparagraph_ordinal"] = ORDINAL_OF[above]
                    shift = False
            ref["candidates"] = _targets(ref, shift)
        ref["subparagraph_index"] = ORDINALS.get(ref["subparagraph_ordinal"] or "")
    return done
