"""Assembled answers: one reading of a page, scopes, states, audits, hard pages."""

import gc
import itertools
import random
import time
import weakref
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sparquill.operators import articles, markup, notes, results, rules
from sparquill.operators.element_rules import SHIPPED, ElementRules

PAGE = (
    "<html><head><title>T &amp; t</title></head><body><nav><a href=/n>n</a></nav><p class='update'>最終更新： 2020</p><ul id=page-category><li class=title>c</li><li>one</li><li>two</li></ul>"
    "<div id=page-body><h2>First</h2>intro <a href='/a'>A</a> <a href='#footer-footnote1' title='said'>*1</a><a href='#footer-footnote2' title='x'>*2</a>"
    "<h3>Inner</h3><table><tr><th>k<td><a href=/cell>v</a></table><div id=comment-box>box<a href=/gone>gone</a></div>"
    "<h2>Second</h2>outro <a href=/b>B</a> &#xFFFD; &#xD800;<a href='#footer-footnote3'>*3</a><table><tr><td>other</table></div>"
    "<ul class=footer-footnote><li><a id=footer-footnote1>*1</a>: said<li><a name=footer-footnote2>*2</a> y <a href=/src>s</a><li><a id=footer-footnote4>*4</a><img src=i><li><a id=footer-footnote5>*5</a></ul></body></html>"
)


@pytest.fixture(scope="module")
def read(spark):
    rows = [(1, "http://h/x", PAGE), (2, "http://h/y", None), (3, "http://h/z", "<p>no container"), (4, None, "<div id=page-body>x"), (5, "http://h/v", "<div id=page-body><video></video></div>")]
    frame = spark.createDataFrame([(*r, "s", "l") for r in rows], "page_id long, url string, html string, status string, lines string")
    return articles.read_pages(frame, selectors=(articles.Selector(element_id="page-body"),))


def by_id(frame):
    return {r["page_id"]: r for r in frame.collect()}


def test_whole_page(read):
    found = by_id(results.assemble(read, with_tables=True, count=None))
    r = found[1]
    assert (r["status"], r["page_title"], r["article_state"], r["total_lines"], r["returned_lines"]) == ("ok", "T & t", "text", 7, 7)
    assert [(x["link_id"], x["href"]) for x in r["links"]] == [(1, "http://h/a"), (2, "http://h/cell"), (3, "http://h/b")] and r["links_scope"] == "whole_article"
    assert [(t["table_idx"], t["line"], t["path"]) for t in r["tables"]] == [(1, 4, ["First", "Inner"]), (2, 7, ["Second"])] and [c["text"] for c in r["cells"]] == ["k", "v [2]", "other"]
    assert {(n["number"], n["agreement"], n["reference_state"], n["definition_state"]) for n in r["notes"]} == {
        (1, "match", "referenced", "text"), (2, "conflict", "referenced", "text"), (3, "unavailable", "referenced", "missing"),
        (4, "unavailable", "unreferenced", "non_text"), (5, "unavailable", "unreferenced", "empty")}
    assert r["selected_notes"] == [1, 2, 3] and r["conflicts"] == [2]
    assert (r["last_updated"], r["categories"], r["tags"]) == ("2020", ["one", "two"], [])
    assert (r["ads_skipped"], r["chrome_skipped"], r["total_tables"]) == (0, 1, 2)
    audit = r["reference_audit"]
    assert (audit["explicit"], audit["invalid"], audit["surrogate"], [s["reference"] for s in audit["samples"]]) == (1, 1, 1, ["&#xFFFD;", "&#xD800;"])
    assert r["replacement_lines"] == [6] and r["structured_audit"]["n"] == 2 and r["structured_audit"]["paths"] == ["/lines/5"] and len(r["warnings"]) == 3
    assert (found[2]["status"], found[3]["status"], found[4]["article_state"]) == ("no_html", "no_container", "text")
    assert found[4]["closed"] is False and (found[5]["status"], found[5]["article_state"]) == ("empty_article", "no_extractable_text")
    assert all(found[i]["lines"] == [] for i in (2, 3, 5))


def test_section_scopes(read):
    r = by_id(results.assemble(read, section="Second", with_tables=True))[1]
    assert [x["line"] for x in r["lines"]] == [5, 6, 7] and r["tables_scope"] == "selected_section" and [t["table_idx"] for t in r["tables"]] == [2]
    assert [x["href"] for x in r["links"]] == ["http://h/b"] and r["selected_notes"] == [3] and r["total_links"] == 3
    r = by_id(results.assemble(read, section="Inner", with_tables=True, with_notes=False))[1]
    assert [x["href"] for x in r["links"]] == ["http://h/cell"] and "notes" not in r.asDict()
    assert by_id(results.assemble(read, section="none"))[1]["status"] == "section_not_found"
    found = by_id(results.assemble(read, find="outro"))[1]
    assert [x["line"] for x in found["lines"]] == [6] and not found["more_after"]
    assert len(by_id(results.assemble(read, find="outro", all_links=True))[1]["links"]) == 3


def test_links_of_note_entries_count(spark):
    page = PAGE.replace("outro", "outro <a href='/src'>again</a>")
    read = articles.read_pages(spark.createDataFrame([(1, "http://h/x", page)], "page_id long, url string, html string"), selectors=(articles.Selector(element_id="page-body"),))
    asked = lambda **k: [x["href"] for x in by_id(results.assemble(read, section="First", count=1, **k))[1]["links"]]
    assert asked() == ["http://h/src"] and asked(with_notes=False) == []


def test_a_part_of_a_links_lines_keeps_it(spark):
    page = PAGE.replace("outro", "<p>x <a href=/long>one<br>two<br>three</a></p>outro")
    read = articles.read_pages(spark.createDataFrame([(1, "http://h/x", page)], "page_id long, url string, html string"), selectors=(articles.Selector(element_id="page-body"),))
    for word in ("one", "two", "three"):
        assert [x["href"] for x in by_id(results.assemble(read, find=word, count=1))[1]["links"]] == ["http://h/long"]


def test_one_reading_in_the_plan(read):
    for frame in (results.assemble(read, with_tables=True), results.rendered(results.assemble(read, with_tables=True)), results.assemble(read, section="First", find="A")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_relations_from_one_reading_equal_those_parsed_alone(spark, read):
    pages = spark.createDataFrame([(1, "http://h/x", PAGE)], "page_id long, url string, html string")
    one = read.where("page_id = 1")
    for relation in (notes.markers, notes.entries, articles.metadata):
        assert relation(one, "page_id").collect() == relation(pages, "page_id").collect()
    alone = articles.parse_pages(pages, selectors=(articles.Selector(element_id="page-body"),))
    assert alone.select("article").collect() == one.select("article").collect()


def test_rules_are_one(spark):
    """The parser's rules and the columns' rules agree, attribute by attribute."""
    cases = [
        [("class", "ad-extra ads-box")], [("class", "user-area ads-box")], [("id", "crt-1")], [("id", "comment-box")], [("data-ad-slot", ""), ("data-ad-client", None)],
        [("id", "comment-box"), ("data-ad-client", "1")], [("class", "comment-form-box"), ("id", "x")], [("id", "page-body"), ("class", "ads-box")], [("class", None)], [],
    ]
    frame = spark.createDataFrame([(i, (dict(c).get("class") or "").split(), dict(c).get("id"), [k for k, _ in c]) for i, c in enumerate(cases)], "i int, c array<string>, e string, a array<string>")
    got = [r[0] for r in frame.orderBy("i").select(rules.element_kind(F.col("c"), F.col("e"), F.col("a"), F.lit(None).cast("string"))).collect()]
    assert got == [SHIPPED.judge(c) for c in cases]
    assert SHIPPED.judge([("src", "//a.example/?u=//x.nend.net/"), ("id", "comment-box")]) == "chrome/chrome_id:comment-box"
    assert SHIPPED.judge([("href", "https://u@Sub.DoubleClick.net.:8/x,y")]) == "ad/ad_host:doubleclick.net"
    assert SHIPPED.judge([("href", "/x, //doubleclick.net/")]) is None and SHIPPED.judge([("data-srcset", "/x 1x, //doubleclick.net/ 2x")]) == "ad/ad_host:doubleclick.net"
    assert ElementRules(ad_hosts=["x.y"], ad_classes=["mine"]).judge([("class", "a mine")]) == "ad/ad_class:mine"


def test_notes_and_links_of_large_pages_take_linear_time():
    entries = "".join(f"<li><a id=footer-footnote{i}>*{i}</a> text {i}" for i in range(60_000))
    pages = {
        "notes": f"<article>{''.join(f'<a href=#footer-footnote{i} title=t>*{i}</a>' for i in range(60_000))}</article><ul class=footer-footnote>{entries}</ul>",
        "nested": "<ul class=footer-footnote>" + "<li><a id=footer-footnote1>*1</a><ul class=footer-footnote>" * 5000,
        "links": "<article>" + "".join(f"<p><a href=/{i}>l</a>" for i in range(100_000)) + "</article>",
        "skipped": "<article>" + "<div id=crt-1>" * 20_000 + "</article>",
        "tables": "<article>" + "<table><tr><td><a href=/x>y</a></table>" * 20_000 + "</article>",
    }
    for name, page in pages.items():
        began = time.process_time()
        parser = markup.Elements()
        found = articles.parse_whole(page, "http://h/", (articles.Selector(tag="article"),), elements=parser)
        markup.as_page(*parser.result())
        assert time.process_time() - began < 12, name
        assert name == "nested" or found[0] in (None, "empty_article"), name


def test_what_a_page_took_goes_with_it():
    """Without a search for cycles, which would let many pages' elements pile up in a worker."""
    gc.collect()
    gc.disable()
    try:
        parser = markup.Elements()
        articles.parse_whole("<article><p>a<a href=/x>b</a></article>", "http://h/", (articles.Selector(tag="article"),), elements=parser)
        gone = weakref.ref(parser)
        del parser
        assert gone() is None
    finally:
        gc.enable()


def test_joined_addresses_are_those_of_the_standard():
    random_ = random.Random(5)
    bits = ["/", "//", ".", "..", "/.", "a", "%20", "~b", "-", "?", "#", ";", ":", " ", "h", "\u00e9"]
    hrefs = ["/", "/a", "/a/b.c", "/a..b", "/.a", "/a/..", "", *("/" * (i % 2) + "".join(random_.choices(bits, k=random_.randint(1, 6))) for i in range(3000))]
    bases = ["http://h/", "https://h.x:80/a/b?c#d", "http://h", "http://h?x", "HTTP://H/", "http:///a", "", "/a", "http://u@h/", "http://h:x/", "//h/a"]
    for base, href in itertools.product(bases, hrefs):
        assert articles.ArticleParser(base, articles.Selector(tag="article")).join(href) == urljoin(base, href), (base, href)
