"""Elements of pages as rows: what links, notes, metadata and audits are made of.

A small tolerant parser writes down each page's elements with the span of text
they hold; which element is inside which follows from their numbers (``node`` to
``last``).  Everything that is asked of them is DataFrame work.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.pieces import by_pieces, uncollected
from sparquill.operators.element_rules import SHIPPED

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template".split())
ENDS = {"p": {"p", "ul", "ol", "table", "div"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
SCOPE = frozenset("article body div footer nav section table ul ol dl".split())

PAGE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("node", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("tag", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("line", T.IntegerType()),
        T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("skipped", T.StringType())]))),
    # footnotes: links to them, the rows that define them, and both by number
    T.StructField("markers", T.ArrayType(T.StructType([T.StructField("number", T.LongType()), T.StructField("title", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("line", T.IntegerType())]))),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField("number", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("hrefs", T.ArrayType(T.StringType()))]))),
    T.StructField("notes", T.ArrayType(T.StructType([
        T.StructField("number", T.LongType()), T.StructField("marks", T.LongType()), T.StructField("titles", T.ArrayType(T.StringType())), T.StructField("title", T.StringType()),
        T.StructField("rows", T.LongType()), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("entry", T.StringType()),
        T.StructField("without_text", T.LongType()), T.StructField("hrefs", T.ArrayType(T.StringType()))]))),
])

# Targets of footnotes, the list at a page's foot that defines them, and what is content without text.
NOTE_TARGET, NOTE_LIST = re.compile("footer-footnote([0-9]{1,9})"), "footer-footnote"
MEDIA = frozenset("img iframe svg canvas video audio object embed table hr".split())


class Elements(HTMLParser):
    """Elements in page order: [node, last, tag, attributes, line, start, size, and
    why the rules skip it, unless an element around it is skipped]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []  # numbers of the open elements
        self.places: dict[str, list[int]] = {}  # in the stack, by tag
        self.scopes: list[int] = []
        self.text: list[str] = []
        self.size = self.quiet = 0
        self.skipping: int | None = None  # place in the stack of the skipped element

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.stack and tag in ENDS.get(self.rows[self.stack[-1] - 1][2], ()):
            self.close_to(len(self.stack) - 1)
        why = SHIPPED.judge(attrs) if attrs and self.skipping is None else None
        self.rows.append([len(self.rows) + 1, len(self.rows) + 1, tag, {k: v or "" for k, v in reversed(attrs)}, self.getpos()[0], self.size, 0, why])
        if tag not in VOID:
            if why:
                self.skipping = len(self.stack)
            self.places.setdefault(tag, []).append(len(self.stack))
            if tag in SCOPE:
                self.scopes.append(len(self.stack))
            self.stack.append(len(self.rows))
            self.quiet += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        places = self.places.get(tag)
        if places and (tag in SCOPE or not self.scopes or self.scopes[-1] <= places[-1]):
            self.close_to(places[-1])

    def close_to(self, place: int) -> None:
        while len(self.stack) > place:
            row = self.rows[self.stack.pop() - 1]
            row[1], row[6] = len(self.rows), self.size - row[5]
            self.places[row[2]].pop()
            self.quiet -= row[2] in SILENT
            if self.skipping == len(self.stack):
                self.skipping = None
            if self.scopes and self.scopes[-1] == len(self.stack):
                self.scopes.pop()

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.text.append(data)
            self.size += len(data)

    def result(self) -> tuple[str, list[list]]:
        self.close_to(0)
        return "".join(self.text), self.rows


def whole_tags(html: str) -> str:
    """``html`` without a tag that its end cuts off: no tag is whole behind the last
    bracket, and the parser would look for its end from each start anew."""
    end = html.rfind(">") + 1
    cut = re.compile("<[a-zA-Z/!?]").search(html, end)
    return html[: cut.start()] if cut else html


def _folded(text: str) -> str:
    return " ".join(text.split())


def note_markers(rows: list[list]) -> list[tuple]:
    """number, title, place among the links, line: links to footnotes."""
    links = [r for r in rows if r[2] == "a"]
    found = ((NOTE_TARGET.fullmatch(r[3].get("href", "").removeprefix("#")) if r[3].get("href", "").startswith("#") else None, i, r) for i, r in enumerate(links, 1))
    return [(int(m[1]), _folded(r[3].get("title", "")), i, r[4]) for m, i, r in found if m]


def note_entries(text: str, rows: list[list]) -> list[tuple]:
    """number, text, ord, hrefs: rows of the note lists that hold one note's target.

    Such a row defines its note with everything inside; a row with several targets
    defines none, and the rows in it are read.  The label in front of the text is
    dropped, and one separator behind it.  A text is null where a row holds links or
    media only, and empty where it holds nothing.  Rows and what is in them are
    found by their numbers, so a page takes linear time, but for the look-ups.
    """
    targets = [(r[0], m[1], r) for r in rows if r[3] and (m := NOTE_TARGET.fullmatch(r[3].get("id") or r[3].get("name") or ""))]
    if not targets:
        return []
    places = [t[0] for t in targets]
    media = [r[0] for r in rows if r[2] in MEDIA]
    links = [r for r in rows if r[2] == "a" and r[3].get("href") and not r[3]["href"].startswith("#")]
    link_places = [r[0] for r in links]
    found, inside, read = [], 0, 0  # numbers up to which a list, and a row that was read, go on
    for r in rows:
        node, last = r[0], r[1]
        if r[2] == "li" and read < node <= inside:
            low, high = bisect_left(places, node), bisect_right(places, last)
            if high > low and len({t[1] for t in targets[low:high]}) == 1:
                read = last
                label = targets[low][2]
                start, end = r[5], r[5] + r[6]
                said = text[start:end] if label is r else text[start : label[5]] + text[label[5] + label[6] : end]
                said = re.sub("^[:：]", "", _folded(said)).strip()
                hrefs = list(dict.fromkeys(x[3]["href"] for x in links[bisect_left(link_places, node) : bisect_right(link_places, last)]))
                held = hrefs or bisect_left(media, node) < bisect_right(media, last)
                found.append((int(targets[low][1]), said or (None if held else ""), node, hrefs))
        if NOTE_LIST in r[3].get("class", "").split():
            inside = max(inside, last)
    return found


def notes_of(marked: list[tuple], defined: list[tuple]) -> list[tuple]:
    """Markers and entries by number."""
    by_number: dict[int, tuple[list, list]] = {}
    for which, rows in ((0, marked), (1, defined)):
        for r in rows:
            by_number.setdefault(r[0], ([], []))[which].append(r)
    out = []
    for number, (marks, entries) in sorted(by_number.items()):
        titles, texts = [m[1] for m in marks], [e[1] for e in entries]
        out.append((number, len(marks), sorted({t for t in titles if t}), min(titles, default=None), len(entries), sorted({t for t in texts if t}),
                    texts[0] if texts else None, sum(t is None for t in texts), list(dict.fromkeys(h for e in entries for h in e[3]))))
    return out


@uncollected
def as_page(text: str | None, rows: list[list]) -> dict:
    """A value of ``PAGE``."""
    marked, defined = note_markers(rows), note_entries(text or "", rows)
    parts = {"elements": rows, "markers": marked, "entries": defined, "notes": notes_of(marked, defined)}
    names = {k: PAGE[k].dataType.elementType.fieldNames() for k in parts}
    return {"text": text} | {k: [dict(zip(names[k], r, strict=True)) for r in v] for k, v in parts.items()}


def parse(html: str | None) -> tuple[str | None, list[list]]:
    if html is None:
        return None, []
    parser = Elements()
    try:
        parser.feed(whole_tags(html))
        parser.close()
    except (AssertionError, ValueError):  # what was read so far stands
        pass
    return parser.result()


@by_pieces(PAGE)
def parsed(htmls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([as_page(*parse(h)) for h in htmls], columns=PAGE.fieldNames())


def page_of(html: str = "html") -> Column:
    """The parsed page (see ``PAGE``) of a column of html."""
    return parsed.asNondeterministic()(html)


def read(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and page: as it is there already (see ``articles.read_pages``), else parsed from ``html``."""
    return pages.select(key, F.col("page") if "page" in pages.columns else page_of(html).alias("page"))


def text_of(e: Column, page: str = "page") -> Column:
    """What an element holds, with white space folded."""
    return folded(F.substring(f"{page}.text", e["start"] + 1, e["size"]))


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def within(e: Column, outer: Column) -> Column:
    return (e["node"] > outer["node"]) & (e["node"] <= outer["last"])


def attribute(e: Column, name: str) -> Column:
    return F.try_element_at(e["attributes"], F.lit(name))


def classes(e: Column) -> Column:
    """Tokens of the class attribute."""
    return F.filter(F.split(F.coalesce(attribute(e, "class"), F.lit("")), r"\s+"), lambda c: c != "")


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", tags: tuple[str, ...] = ()) -> DataFrame:
    """key, pos, node, last, tag, attributes, line and text of each element (of the
    given tags, if any; ``pos`` counts these), in page order.  An element holds
    those numbered from its ``node`` to ``last``; ``text`` is all that is in it."""
    page = read(pages, key, html)
    found = F.filter("page.elements", lambda e: e["tag"].isin(*tags)) if tags else F.col("page.elements")
    rows = F.transform(found, lambda e, i: F.struct(
        (i + 1).cast("long").alias("pos"), *[e[c].alias(c) for c in ("node", "last", "tag", "attributes", "line")], text_of(e).alias("text")))
    return page.select(key, F.inline(rows))
