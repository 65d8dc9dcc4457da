"""Structure, citations in context, audit, summaries, sources, batch and stream."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from legalspark.functions.citation_grammar import extract, in_context
from legalspark.functions.dom import parse
from legalspark.operators import citations, coverage, scan, validate
from legalspark.operators.structure import expected_counts, read_act
from legalspark.operators.summary import read_summary, summaries
from legalspark.plans import batch
from legalspark.plans.batch import audit, run_batch
from legalspark.plans.parse import parse_documents, parse_html
from legalspark.sources import documents as sources

COLS = '<colgroup><col width="5%"><col width="95%"></colgroup>'


def rows_table(*rows, cols=COLS):
    return f"<table>{cols}<tbody>" + "".join(f"<tr><td><p>{a}</p></td><td>{b}</td></tr>" for a, b in rows) + "</tbody></table>"


def art(n, body, heading="Scope"):
    return f'<div id="art_{n}" class="eli-subdivision"><p class="oj-ti-art">Article {n}</p><div class="eli-title"><p class="oj-sti-art">{heading}</p></div>{body}</div>'


def p(text):
    return f'<p class="oj-normal">{text}</p>'


def ids(html):
    return [u["id"] for u in read_act(html)]


def by_id(html):
    return {u["id"]: u for u in read_act(html)}


def test_title_drops_the_relevance_line():
    html = '<div class="eli-main-title"><p class="oj-doc-ti">REGULATION</p><p class="oj-doc-ti">of 1 May</p><p class="oj-doc-ti">(Text with EEA relevance)</p></div>'
    (u,) = read_act(html)
    assert (u["id"], u["text"]) == ("document-title", "REGULATION of 1 May")


def test_points_below_a_numbered_paragraph():
    nested = rows_table(("(i)", p("inner")))
    html = art(1, '<div id="001.001">' + p("1. These apply:") + rows_table(("(a)", p("first") + nested + p("goes on")), ("(b)", p("second"))) + p("Then more text.") + "</div>")
    assert ids(html) == ["art-1", "art-1.par-1", "art-1.par-1.pt-a", "art-1.par-1.pt-a.sub-i", "art-1.par-1.pt-a.cont-1", "art-1.par-1.pt-b", "art-1.par-1.subpar-1"]
    u = by_id(html)
    assert u["art-1.par-1"]["text"] == "These apply:" and u["art-1.par-1"]["paragraph_index"] is None and u["art-1.par-1.subpar-1"]["subparagraph_index"] == 1
    assert u["art-1.par-1.pt-a.sub-i"]["subpoint_label"] == "i" and u["art-1.par-1.pt-a"]["text"] == "first"


def test_deep_nesting_and_extra_labels():
    inner = rows_table(("(1)", p("deep")))
    for label in ("(x)", "(i)", "(b)", "(a)"):
        inner = rows_table((label, p("lvl") + inner))
    u = read_act(art(1, p("Lead text here.") + inner))
    assert u[-1]["type"] == "nested_4" and u[-1]["extra_labels"] == ["1"] and u[-1]["id"].endswith(".n3-x.n4-1")


def test_direct_content_and_tables_without_text():
    assert ids(art(2, p("Only text.") + p("And more."))) == ["art-2", "art-2.par-1", "art-2.par-1.subpar-1"]
    assert ids(art(2, rows_table(("(a)", p("lost"))))) == ["art-2"]
    assert ids(art(3, '<div id="003.002">' + rows_table(("(a)", p("kept"))) + "</div>")) == ["art-3", "art-3.par-2", "art-3.par-2.pt-a"]


def test_other_tables_and_bare_strings():
    html = art(5, '<div id="005.001">' + p("1. Lead.") + "<table><tr><td>" + p("a single cell of text") + "</td></tr></table>a bare string of text</div>")
    u = by_id(html)
    assert u["art-5.par-1.subpar-1"]["text"] == "a bare string of text"
    assert u["art-5.par-1.subpar-1.tbl-1"]["type"] == "point"  # a waiting table goes to the parent of the moment
    u = by_id(html.replace("a bare string of text", p("a paragraph of text")))
    assert u["art-5.par-1.tbl-1"]["type"] == "subparagraph"


def test_amending_article():
    html = art(3, p("Regulation X is amended as follows:") + rows_table(("(1)", p("in Article 2"))) + p("new words here") + p("new words here") + "<ul><li>some other listed text</li></ul>", "Amendments to X")
    got = read_act(html)
    assert [u["id"] for u in got] == ["art-3", "art-3.par-1", "art-3.par-1.pt-1", "art-3.par-1.subpar-1", "art-3.par-1.unk-2"]
    assert all(u["is_amendment_text"] for u in got[1:])


def test_recitals():
    table = f'<div id="rct_1" class="eli-subdivision">{rows_table(("(1)", p("One") + "<ul><li>two</li></ul>" + p("three")))}</div>'
    plain = f'<div id="rct_2" class="eli-subdivision">{p("2. First<a href=&quot;#ntr3&quot;>(3)</a> part")}{p("second part")}</div><div id="rct_3" class="eli-subdivision"></div>'
    u = read_act(table + plain)
    assert [(x["id"], x["text"]) for x in u] == [("recital-1", "One two three"), ("recital-2", "First part second part")]


def test_consolidated():
    grid = '<div class="grid-container"><div class="grid-list-column-1"><span>(a)</span></div><div class="grid-list-column-2"><p class="norm">point text</p></div></div>'
    html = f'<div id="art_2" class="eli-subdivision"><p class="title-article-norm">Article 2</p><p class="stitle-article-norm">Scope</p><p class="norm">Intro.</p><div class="norm"><span class="no-parag">1.  </span><div class="inline-element"><p class="norm">Body:</p>{grid}</div></div><div class="norm">dropped</div></div>'
    u = read_act(html)
    assert [(x["id"], x["text"]) for x in u] == [("art-2", ""), ("art-2.intro-1", "Intro."), ("art-2.par-1", "Body:"), ("art-2.par-1.pt-a", "point text")]
    assert u[0]["heading"] == "Scope"


def test_consolidated_without_a_number_is_renamed():
    html = '<div id="art_9" class="eli-subdivision"><p class="title-article-norm">A</p><div class="norm"><span class="no-parag">.</span>text <div class="grid-container"><div class="list">-</div></div></div></div>'
    got = read_act(html)
    assert [(u["id"], u["parent_id"]) for u in got] == [("art-9", None), ("art-9_1", "art-9"), ("art-9.pt-—", "art-9")]


def test_annex():
    html = '<div id=" anx_I " class="eli-container"><p class="oj-doc-ti">ANNEX I</p><p class="oj-ti-grseq-1"><span>List</span><span>of things</span></p><p class="oj-ti-grseq-1">Part B of it</p>' + rows_table(("(a)", p("item one"))) + p("loose text") + "<table><tr><td>cell text</td><td>x</td></tr></table></div>"
    u = read_act(html)
    assert [x["id"] for x in u] == ["annex-I", "annex-I.part-B", "annex-I.part-B.item-a", "annex-I.part-B.item-1", "annex-I.part-B.item-2"]
    assert u[0]["heading"] == "List of things" and u[2]["annex_part"] == "B"
    assert expected_counts(html) == {"recitals": 0, "articles": 0, "annexes": 0}


def test_empty_and_broken_html():
    assert read_act(None) == read_act("") == read_act("<p><b>unclosed <td> x</p></div>") == []
    assert [n.tag for n in parse("<ul><li>a<li>b</ul><p>x<p>y<br>z").walk()] == ["ul", "li", "li", "p", "p", "br"]
    assert parse('<script>var t="</p>";</script><p>ok<!-- no --></p>').text() == "ok"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Article 6a(1)(c)", [("art-6a.par-1.pt-c", None)]),
        ("Articles 3, 5 and 6a", [("art-3", None), ("art-5", None), ("art-6a", None)]),
        ("Article 43 or Article 44(2)", [("art-43", None), ("art-44.par-2", None)]),
        ("points (a) to (d) of Article 2(1)", [("art-2.par-1", None)]),
        ("point (a)", []),
        ("paragraphs 1, 2 or 3", [("par-1", None), ("par-2", None), ("par-3", None)]),
        ("paragraphs 2 to 4", [(None, None)]),
        ("the first and second subparagraphs of this paragraph", [(None, None)] * 2),
        ("the second subparagraph of paragraph 1", [("par-1.subpar-2", None)]),
        ("Section C of Annex I", [(None, None), ("annex-I", None)]),
        ("Article 16 of Regulations (EU) 2016/679 and (EC) No 45/2001", [("art-16", "32016R0679"), ("art-16", "32001R0045")]),
        ("Articles 10 to 14 of Decision 2010/87", [(None, "32010D0087")]),
        ("Directive 95/46/EC", [(None, "31995L0046")]),
        ("Regulation (EEC) No 2658/87", [(None, "31987R2658")]),
        ("Framework Decision 2002/584/JHA", [(None, None)]),
        ("Regulations (EU) No 10/2010", []),
        ("Article 5 of the Treaty", [(None, None)]),
        ("", []),
    ],
)
def test_citations(text, want):
    got = extract(text)
    assert [(r["target_node_id"], r["celex"]) for r in got] == want
    assert all(text[r["span_start"] : r["span_end"]] == r["raw_text"] for r in got)


def test_connectives_take_the_longest_ending():
    (r,) = extract("as laid down in Article 5")
    assert r["connective_phrase"] == "as laid down in"
    (r,) = extract("thereunder Article 5")
    assert r["connective_phrase"] == "under"


def test_context():
    text = "Article 3(2) and points (a) and (b); points (c) or (d) of this Article"
    got = in_context(extract(text), text, "7", 4, None, 2)
    points = {r["point"]: r["candidates"] for r in got if r["point"]}
    assert points["a"] == ["art-3.par-2.pt-a", "art-3.par-2"]
    assert points["c"][0] == "art-7.par-4.subpar-2.pt-c"
    sub = in_context(extract("the second subparagraph"), "the second subparagraph", "7", 1, None, None)[0]
    assert sub["candidates"] == ["art-7.par-1.subpar-1", "art-7.par-1.subpar-2"] and sub["subparagraph_index"] == 2
    part = in_context(extract("Annex II, Part A"), "", None, None, None, None)[0]
    assert part["candidates"] == ["annex-II.part-A", "annex-II"]
    two = "Regulation (EU) 2016/679, Regulation (EU) 2018/1725 and that Regulation"
    assert in_context(extract(two), two, None, None, None, None)[-1]["citation_type"] == "internal"


DOC = art(1, '<div id="001.001">' + p("1. Under paragraph 2 and Article 2(1):") + rows_table(("(a)", p("alpha of Regulation (EU) 2016/679 here")), ("(b)", p("beta, a longer text"))) + '</div><div id="001.002">' + p("2. Another one stands here.") + "</div>", "Definitions") + art(2, p("Text of article two, see this Article."))


def test_whole_document(spark):
    parsed = parse_html(spark, DOC, "a.html")
    units = {u.id: u for u in parsed.units.collect()}
    assert [c.target_node_id for c in units["art-1.par-1"].citations] == ["art-1.par-2", "art-2.par-1"]
    assert units["art-1.par-1"].is_stem and units["art-1.par-1"].children_count == 2 and units["art-2.par-1"].target_path == "Art. 2(1)"
    assert units["art-2.par-1"].citations[0].target_node_id == "art-2" and units["art-1.par-2"].article_heading == "Definitions"
    about = parsed.metadata.first()
    assert (about.total_units, about.total_points, about.total_definitions, about.has_annexes, about.amendment_articles) == (7, 2, 2, False, [])
    root = json.loads(parsed.payload().first().payload)
    assert list(root) == ["document_metadata", "summary_lsu", "summary_lsu_status", "units"] and root["summary_lsu_status"] == "disabled"
    assert len(root["units"]) == 7 and set(root["units"][0]) == set(__import__("legalspark.schema", fromlist=["x"]).UNIT_COLUMNS)
    for oracle in ("naive", "mirror"):
        row = audit(parsed, oracle).first()
        assert row.passed and row.gone == 0 and row.phantom_count == 0


def test_documents_without_units(spark):
    docs = spark.createDataFrame([("x", "f", None, None), ("y", "g", "<p>none</p>", None)], "doc_id string, source_file string, html string, celex string")
    parsed = parse_documents(docs)
    assert parsed.units.count() == 0 and parsed.validation.where("is_valid").count() == 2
    assert json.loads(parsed.payload().where("doc_id = 'x'").first().payload)["units"] == []


def test_lost_misplaced_and_invented_text(spark):
    texts = spark.createDataFrame([("d", "art_1", "paragraph", "first paragraph"), ("d", "art_1", "paragraph", "first paragraph"), ("d", "art_1", "point", "as a point"), ("d", "art_1", "full", "first paragraph as a point")], "doc_id string, section string, kind string, text string")
    units = spark.createDataFrame([("d", "paragraph", None, "1", "first paragraph"), ("d", "paragraph", None, "1", "as a point"), ("d", "point", None, "1", "invented text")], "doc_id string, type string, annex_number string, article_number string, text string")
    row = coverage.mirror_coverage(units, texts).first()
    assert (row.total_html_segments, row.total_missing, row.gone, row.misclassified) == (3, 2, 0, 2)
    assert [r.text for r in coverage.phantoms(units, texts).collect()] == ["invented text"]


def test_integrity(spark):
    units = spark.createDataFrame([("d", 0, "a", "paragraph", None, "2", None), ("d", 1, "a.pt-b", "point", "gone", None, "b"), ("d", 2, "x", "subpoint", "a", None, None), ("d", 3, "recital-3", "recital", "", None, None)], "doc_id string, pos int, id string, type string, parent_id string, paragraph_number string, point_label string")
    got = {(r.kind, r.id) for r in validate.hierarchy_issues(units).collect()}
    assert got == {("orphan", "a.pt-b"), ("wrong_parent_type", "x"), ("id_mismatch", "a")}
    gaps = validate.recital_gaps(units.withColumn("recital_number", F.when(F.col("type") == "recital", "3")))
    assert gaps.first().missing == [1, 2]


SUMMARY = '<link rel="canonical" href="/x"><h1>Title</h1><section id="lseu-section-1"><h2>Aim</h2><p>It does.</p><ul><li>one</li><li>two</li></ul></section><p class="lseu-lastmod">last update <time datetime="2020-01-02">2.1.2020</time></p>'


def test_summary_pages():
    got, status = read_summary(SUMMARY, "32016R0679", "EN", "https://h.test/a")
    assert status == "ok" and got["canonical_url"] == "https://h.test/x" and got["sections"] == [{"heading": "Aim", "content": "It does.\n- one\n- two"}] and got["last_modified_date"] == "2020-01-02"
    assert read_summary('<div class="alert alert-warning">The requested document does not exist.</div><h1>x</h1>', "c", "EN", "u") == (None, "not_found")
    assert read_summary("", "c", "EN", "u") == (None, "not_found")


def test_summaries_by_candidate(spark):
    docs = spark.createDataFrame([("a", "02016R0679-20200101.html", "<html lang='en'>", None), ("b", "none.html", "<p>", None), ("c", "32001L0095.html", "<p>", None), ("d", "32001L0096.html", "", None)], "doc_id string, source_file string, html string, celex string")
    pages = spark.createDataFrame([("32016R0679", "EN", SUMMARY, "u", None, False), ("32001L0095", "EN", "", "u", None, False), ("32001L0096", "EN", None, "u", None, True)], "celex string, language string, html string, url string, final_url string, failed boolean")
    got = {r.doc_id: (r.status, r.summary and r.summary.title) for r in summaries(docs, pages).collect()}
    assert got == {"a": ("ok", "Title"), "b": ("celex_missing", None), "c": ("not_found", None), "d": ("fetch_error", None)}


def test_links(spark, tmp_path):
    (tmp_path / "l.csv").write_text('url,celex,title,category\n http://a , 32016R0679,"T, ""x""", cat \n', encoding="utf-8")
    assert sources.convert_links(spark, str(tmp_path / "l.csv"), str(tmp_path / "l.json")) == 1
    assert tuple(sources.links_json(spark, str(tmp_path / "l.json")).first()) == ("http://a", "32016R0679", 'T, "x"', "cat", "candidate_csv")
    rows = spark.createDataFrame([(k,) for k in range(6)], "pos int")
    assert [r.pos for r in sources.sliced(rows, "pos", 2, 3).collect()] == [2, 3, 4]
    for bad in ({"offset": -1}, {"limit": 0}):
        with pytest.raises(ValueError):
            sources.sliced(rows, "pos", **bad)


def test_batch(spark):
    links = spark.createDataFrame([("http://x/legal-content/FR/TXT/?uri=CELEX:1", "32016R0679"), ("http://short", None), ("http://fails", None), ("http://have", "32000R0001")], "url string, celex string")
    page = DOC + "<p>" + "x" * 1000 + "</p>"

    def fetch(url):
        if "fails" in url:
            raise OSError("no route")
        return ("short", url) if "short" in url else (page, url)

    already = spark.createDataFrame([("32000R0001", page)], "key string, html string")
    got = {r.url[:12]: r for r in run_batch(links, fetch, already).collect()}
    assert len(got) == 4 and got["http://x/leg"].passed and got["http://x/leg"].download.final_url.endswith("/EN/TXT/?uri=CELEX:1")
    assert got["http://short"].notes == "download: content_too_short" and got["http://fails"].download.error == "no route" and not got["http://fails"].passed
    assert got["http://have"].passed and got["http://have"].download.method == "cache" and got["http://have"].notes == "already_downloaded"
    payloads = spark.createDataFrame([("32016R0679", '{"units": {}}'), ("32000R0001", '{"units": []}')], "doc_id string, payload string")
    again = {r.key: r for r in run_batch(links.where("celex is not null"), fetch, already, parsed_before=payloads).collect()}
    assert again["32016R0679"].notes == "payload: key 'units' must be a list" and not again["32016R0679"].passed
    assert again["32000R0001"].gone > 0 and not again["32000R0001"].passed
    assert all(r.passed for r in run_batch(links.where("celex is not null"), fetch, already, parsed_before=payloads, force=True).collect())


def test_a_document_that_cannot_be_read_fails_alone(spark, monkeypatch):
    deep = "<div>" * 4000 + DOC
    docs = spark.createDataFrame([("good", "", DOC, None), ("deep", "", deep, None)], "doc_id string, source_file string, html string, celex string")
    parsed = parse_documents(docs)
    bad = {r.doc_id for r in parsed.errors.collect()}
    assert bad <= {"deep"} and {r.doc_id for r in parsed.units.select("doc_id").distinct().collect()} == {"good", "deep"} - bad
    assert [r["kind"] for r in scan.document_rows(5, "", True, True)] == ["error"]


def test_download_falls_back_and_reports(spark):
    page = DOC + "<p>" + "x" * 1000 + "</p>"

    def first(url):
        raise ImportError("no browser")

    def second(url):
        if "gone" in url:
            raise sources.HttpError(404)
        return page, url

    links = spark.createDataFrame([("http://a", "32016R0679"), ("http://gone", None)], "url string, celex string")
    rows = {r.url: r for r in batch.download_and_parse(links, methods=(("browser", first), ("http", second))).collect()}
    assert rows["http://a"].status == "ok" and '"units":[{' in rows["http://a"].payload
    assert rows["http://gone"].status == "http_404" and rows["http://gone"].payload is None
    assert sources.fetched("u", (("browser", first),))["status"] == "browser_missing"


def test_payloads_are_guarded_and_audited(spark):
    docs = spark.createDataFrame([(k, "", DOC, None) for k in "abcd"], "doc_id string, source_file string, html string, celex string")
    own = parse_documents(docs).payload().where("doc_id = 'a'").first().payload
    payloads = spark.createDataFrame([("a", own), ("b", "[1]"), ("c", '{"units": 3}'), ("d", "{")], "doc_id string, payload string")
    got = {r.doc_id: r for r in batch.audit_payloads(docs, payloads, "mirror").collect()}
    assert got["a"].passed and got["a"].fault is None and got["a"].gone == 0
    assert [got[k].fault for k in "bcd"] == ["expected object root with key 'units'", "key 'units' must be a list", "not JSON"]
    assert not any(got[k].passed for k in "bcd")


def test_report_lists_what_is_lost(spark):
    docs = spark.createDataFrame([("a", "", DOC, None)], "doc_id string, source_file string, html string, celex string")
    whole = parse_documents(docs)
    assert batch.report(whole, "mirror").first().missing_texts is None
    short = dataclasses.replace(whole, raw=whole.raw.where("type <> 'point'"))
    row = batch.report(short, "mirror").first()
    assert row.missing_texts and {x.how for x in row.missing_texts} == {"gone"} and row.coverage_pct == round(row.coverage_pct, 1) and not row.passed
    assert batch.report(short, "naive").first().missing_texts


def test_targets_in_the_pass_equal_those_by_joins(spark):
    docs = spark.createDataFrame([("a", "", DOC, None), ("b", "", DOC.replace("Article 1(1)", "Article 9(9)"), None)], "doc_id string, source_file string, html string, celex string")
    raw = parse_documents(docs).raw
    joined = citations.resolved_citations(raw.drop("citations")).collect()
    assert {(r.doc_id, r.pos): r.citations for r in joined} == {(r.doc_id, r.pos): r.citations for r in raw.select("doc_id", "pos", "citations").collect()}
    walked = citations.resolved_citations(raw.drop("citations", "subparagraph_above")).collect()
    assert sorted(map(str, walked)) == sorted(map(str, joined))


def test_schemas_of_what_is_written(spark, tmp_path):


    from legalspark import schema
    from legalspark.plans.cli import main

    assert main(["schemas", str(tmp_path), "--check"]) == 1
    assert main(["schemas", str(tmp_path)]) == 0 and main(["schemas", str(tmp_path), "--check"]) == 0
    (tmp_path / "payload.schema.json").write_text("{}")
    assert schema.check_schemas(str(tmp_path)) == ["payload.schema.json"]
    payload = json.loads(parse_html(spark, DOC).payload().first().payload)
    defs = schema.json_schemas()["payload.schema.json"]["$defs"]
    assert list(payload) == schema.json_schemas()["payload.schema.json"]["required"]
    for unit in payload["units"]:
        assert sorted(unit) == sorted(defs["Unit"]["required"])
        assert all(sorted(c) == sorted(defs["Citation"]["required"]) for c in unit["citations"])
    assert schema.MODELS["Citation"]["citation_type"].metadata["enum"] == ["internal", "eu_legislation"]
    about = payload["document_metadata"]
    assert sorted(about) == sorted(defs["DocumentMetadata"]["required"])


def test_files_cli_and_stream(spark, tmp_path):
    from legalspark.plans.cli import main
    from legalspark.streaming.ingest import html_stream, parse_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.html").write_text(DOC, encoding="utf-8")
    assert [r.doc_id for r in sources.html_files(spark, str(folder)).collect()] == ["one"]
    assert main(["coverage", str(folder), "--oracle", "mirror", "--report", str(tmp_path / "r")]) == 0
    assert main(["parse", str(folder), "--out", str(tmp_path / "o"), "--validation", str(tmp_path / "v"), "--coverage", "--celex", "32016R0679"]) == 0
    assert spark.read.json(str(tmp_path / "v")).first().counts_expected.articles == 2
    payload = spark.read.json(str(tmp_path / "o")).first().payload
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "one.json").write_text(payload)
    assert main(["coverage", str(folder), "--oracle", "mirror", "--json", str(tmp_path / "json")]) == 0
    (tmp_path / "json" / "one.json").write_text("[]")
    assert main(["coverage", str(folder), "--json", str(tmp_path / "json"), "--verbose"]) == 1
    (tmp_path / "links.jsonl").write_text('{"url": "http://x", "celex": "c1"}\n{"url": "http://y", "celex": "c2"}\n')
    spark.createDataFrame([("c1", DOC + "x" * 1000), ("c2", "<p>nothing</p>" * 100)], "key string, html string").write.parquet(str(tmp_path / "pages"))
    assert main(["batch", "--links-file", str(tmp_path / "links.jsonl"), "--limit", "1", "--oracle", "mirror", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "b"), "--snapshot-tag", "t 1"]) == 0
    assert spark.read.json(str(tmp_path / "b" / "snapshots" / "t_1" / "results")).first().key == "c1"
    query = parse_stream(html_stream(spark, str(folder)), str(tmp_path / "s"), str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s" / "units")).count() == 7


def test_well_formed_markup_gives_the_same_tree_by_expat_as_by_pattern():
    from legalspark.functions import dom

    def shape(n):
        return n.tag, n.attrs, [k if isinstance(k, str) else shape(k) for k in n.kids]

    plain = '<div id="a" class="x y"><p>One &amp; two<br>three</p><table><colgroup><col width="5%"><col/></colgroup><tbody><tr><td><p>(a)</p></td><td><p>b<div>c</div></p></td></tr></tbody></table><div/>é</div>tail'
    left = ("<p/>x", "<p>a<p>b", "a &nbsp; b", '<span class="a\nb">c</span>', "<script>a</script>", "<!-- c --><p>d</p>", "<DIV>e</DIV>x&#39;", "a < b")
    for html in (plain, *left):
        by_pattern = dom._Builder()
        by_pattern.feed(html)
        assert shape(dom.parse(html)) == shape(by_pattern.root), html
    assert dom._well_formed(plain) is not None and all(dom._well_formed(h) is None for h in left)
    root = dom.parse(plain)
    for n in (root, *root.walk()):
        below = [k for k in n.walk() if k.tag == "p"]
        assert n.all("p") == below and n.first("p") == next(iter(below), None) and all(k.inside(n.tag) for k in below)


def test_texts_of_one_form_are_matched_once_and_read_with_their_own_numbers():
    from legalspark.functions import citation_grammar as g

    texts = [f"point ({c}) of the second subparagraph of Article {a}({p}) of Regulation (EU) No {n}/2013" for c, a, p, n in (("a", 1, 10, 575), ("a", 7, 42, 107), ("a", 9, 99, 999))]
    g._kept_claims.cache_clear()
    got = [g.extract(t) for t in texts]
    assert g._kept_claims.cache_info().misses == 1 and g._kept_claims.cache_info().hits == 2
    assert [(r["article"], r["paragraph"], r["celex"], r["span_end"], r["target_node_id"]) for (r,) in got] == [
        (1, 10, "32013R0575", len(texts[0]), "art-1.par-10.subpar-2.pt-a"), (7, 42, "32013R0107", len(texts[1]), "art-7.par-42.subpar-2.pt-a"), (9, 99, "32013R0999", len(texts[2]), "art-9.par-99.subpar-2.pt-a"),
    ]
    that = "{} (EU) 2016/679 and Article 4 of that Regulation"
    assert [r["celex"] for r in g.extract(that.format("Regulation"))] == ["32016R0679", "32016R0679"] and [r["celex"] for r in g.extract(that.format("Directive"))][0] == "32016L0679"


def test_html_elements_reads_the_references_that_its_sql_reads(spark, tmp_path):
    from legalspark.plans import queries as Q

    titles = ["a&amp", "b = &quot;c", "it&#39;s &amp; more", "&amp;amp;  d"]
    spark.createDataFrame([(k, f"<html><head><title>{t}</title></head><p>x</p><ul><li>y</ul></html>") for k, t in enumerate(titles)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.title, r.li, r.a, r.p) for r in Q.queries()["html_elements"](spark, str(tmp_path)).collect()}
    assert got == {0: ("a&amp", 1, 0, 1), 1: ("b = &quot;c", 1, 0, 1), 2: ("it's & more", 1, 0, 1), 3: ("&amp; d", 1, 0, 1)}
