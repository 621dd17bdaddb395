"""Articles: HTML pages parsed once into nested rows, exploded on demand.

One Arrow UDF turns a page's html into a struct of lines, headings, links,
cells, images and metadata; everything after that is DataFrame work.  A page
that cannot be parsed gives an ``error_code`` and empty parts, never a failed
job.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.pieces import by_pieces, uncollected
from sparquill.functions.urls import page_title
from sparquill.operators import markup, rules
from sparquill.operators.element_rules import SHIPPED, ElementRules

# Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("iframe noscript object script style svg template".split())
STRUCK = frozenset(("del", "s", "strike"))
IMPLIED_END = {  # an open element of the first kind ends where one of the second begins
    "p": BLOCKS - {"br", "tbody", "thead", "tfoot", "tr", "li", "dd", "dt"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"},
}
SCOPE = frozenset("article body div section table td th ul ol dl html".split())
MAX_BYTES, CHUNK = 24 << 20, 64 << 10
# How silent an open element is: not, skipped by a rule, or of a kind whose text is never one.
SHOWN, SKIPPED, RAW = range(3)
LINK_MODES = ("references", "inline", "off")
NOTE = re.compile("#footer-footnote([0-9]{1,9})")
HEADINGS = {f"h{n}": n for n in range(1, 7)}
_SPACES = re.compile(r"\s+")
# Addresses that joining leaves as they are, and bases that one with a path of its own takes the beginning of.
_PLAIN, _HOST = re.compile("[A-Za-z0-9_~%./-]+"), re.compile("https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?=/|$)")


@dataclass(frozen=True)
class Selector:
    """Which element holds the article, by tag, id or class; the first in page order."""

    tag: str | None = None
    element_id: str | None = None
    class_name: str | None = None

    @property
    def name(self) -> str:
        return (self.tag or "") + (f"#{self.element_id}" if self.element_id else "") + (f".{self.class_name}" if self.class_name else "")

    def fits(self, tag: str, attributes: dict[str, str]) -> bool:
        return (
            (self.tag is None or tag == self.tag)
            and (self.element_id is None or attributes.get("id") == self.element_id)
            and (self.class_name is None or self.class_name in attributes.get("class", "").split())
        )


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _string(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ARTICLE = T.StructType([
    *_string("error_code", "page_title"),
    T.StructField("lines", T.ArrayType(T.StringType())),
    T.StructField("headings", T.ArrayType(T.StructType([*_long("level", "line", "source_line"), *_string("text")]))),
    T.StructField("links", T.ArrayType(T.StructType([*_long("link_id"), *_string("href"), T.StructField("original_hrefs", T.ArrayType(T.StringType()))]))),
    T.StructField("line_links", T.ArrayType(T.StructType(_long("line", "link_id")))),
    T.StructField("line_notes", T.ArrayType(T.StructType(_long("line", "number")))),
    T.StructField("cells", T.ArrayType(T.StructType([
        *_long("table_idx", "row_idx", "cell_idx", "rowspan", "colspan"), *_string("rowspan_raw", "colspan_raw", "tag", "text"), *_long("outer_table"),
        T.StructField("link_ids", T.ArrayType(T.LongType())), T.StructField("notes", T.ArrayType(T.LongType()))]))),
    T.StructField("images", T.ArrayType(T.StructType([*_string("src", "alt", "url", "width", "height", "srcset"), *_long("source_line")]))),
    T.StructField("container", T.StringType()),
    T.StructField("closed", T.BooleanType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    # of each line, in the order of lines
    T.StructField("line_refs", T.ArrayType(T.StructType([T.StructField("link_ids", T.ArrayType(T.LongType())), T.StructField("notes", T.ArrayType(T.LongType()))]))),
    T.StructField("tables", T.ArrayType(T.StructType([*_long("table_idx", "line"), T.StructField("path", T.ArrayType(T.StringType()))]))),
    T.StructField("skips", T.ArrayType(T.StructType([*_string("kind", "reason", "tag"), *_long("line")]))),
    # what the container holds beside its lines: text that no line shows, media, forms, areas of the article and how many of them end
    T.StructField("content", T.StructType([*[T.StructField(n, T.BooleanType()) for n in ("has_text", "has_media", "has_forms")], *_long("areas", "closed_areas")])),
])

# Elements that are content without text, and those that only take input.
MEDIA = frozenset("img iframe svg canvas video audio object embed table hr".split())
FORMS = frozenset("form textarea select button input".split())


class ArticleParser(HTMLParser):
    """Follows one container; writes text, boundaries and marks as it goes.

    Open elements are found by tag through their places in the stack, so no end
    tag looks through all of them."""

    def __init__(self, base: str, selector: Selector, skip: ElementRules | frozenset[str] = SHIPPED, link_mode: str = "references"):
        super().__init__(convert_charrefs=True)
        self.base, self.selector, self.link_mode = base, selector, link_mode
        self.host = m[0] if (m := _HOST.match(base)) else None
        self.schemes = {"", "http", "https", base.partition(":")[0].lower()}  # of links; others show as text
        self.rules = skip if isinstance(skip, ElementRules) else ElementRules(ad_classes=skip)
        #: Open elements, how silent they are (see ``SHOWN``), and whether they are in an area of the article.
        self.stack: list[tuple[str, int, bool]] = []
        self.skips: list[tuple[str, str, str, int]] = []
        self.has = dict.fromkeys(("text", "media", "forms"), False)
        self.areas = self.closed_areas = 0
        self.places: dict[str, list[int]] = {}  # in the stack, by tag
        self.scopes: list[int] = []
        self.ending: list[int] = []  # of elements that may end without an end tag, and of scopes
        self.depth = None  # of the container
        self.closed = self.has_area = self.own_end = False  # own_end: the container has an end tag of its own
        self.title: list[str] = []
        self.out: list[tuple[str, bool]] = []  # text, and whether it is in an area
        self.marks: list[tuple[str, int, object, int]] = []  # kind, place in out, value, source line
        self.links: dict[str, int] = {}
        self.images: list[tuple] = []
        self.cells: list[list] = []
        self.tables: list[list[int]] = []  # index, row, cell of the open tables
        self.n_tables = 0
        self.open_cells: list[tuple[int, int]] = []  # index in cells, and where its text begins
        self.hrefs: list[tuple[int, str, int] | None] = []  # of the open anchors: link id, href, place in out
        self.warnings: list[str] = []

    def silent(self) -> bool:
        return self.depth is None or self.closed or bool(self.stack and self.stack[-1][1])

    def write(self, text: str) -> None:
        self.out.append((text, bool(self.stack) and self.stack[-1][2]))

    def replace(self, begin: int, text: str) -> None:
        """Puts one piece in place of all from ``begin`` on, with their marks."""
        inside = self.out[begin][1] if begin < len(self.out) else bool(self.stack and self.stack[-1][2])
        i = len(self.marks) - 1
        while i >= 0 and self.marks[i][1] > begin:
            kind, _, value, line = self.marks[i]
            self.marks[i] = (kind, begin, value, line)
            i -= 1
        self.out[begin:] = [(text, inside)]

    def mark(self, kind: str, value: object) -> None:
        self.marks.append((kind, len(self.out), value, self.getpos()[0]))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = {k: v or "" for k, v in attrs}
        while self.ending and tag in IMPLIED_END.get(self.stack[self.ending[-1]][0], ()):
            self.close_to(self.ending[-1])
        classes = attributes["class"].split() if "class" in attributes else ()
        area = bool(self.stack) and self.stack[-1][2]
        if self.depth is None and not self.closed and self.selector.fits(tag, attributes):
            self.depth = len(self.stack)
            self.push(tag, SHOWN, False)
            return
        quiet = self.stack[-1][1] if self.stack else SHOWN
        inside = self.depth is not None and not self.closed
        if inside and quiet != RAW:
            self.has["media"] |= tag in MEDIA
            self.has["forms"] |= tag in FORMS
        if inside and quiet == SHOWN and attrs and (why := self.rules.judge(attrs)):
            quiet = SKIPPED
            self.skips.append((*why.split("/", 1), tag, self.getpos()[0]))
        if tag in SILENT:
            quiet = RAW
        if inside and classes and not area and not quiet and not set(classes).isdisjoint(rules.ARTICLE_CLASSES):
            area = True
            self.areas += 1
            self.has_area = self.has_area or rules.ARTICLE_CLASSES[0] in classes
        if tag not in VOID:
            self.push(tag, quiet, area)
        if not quiet and not self.silent():
            self.open(tag, attributes)

    def push(self, tag: str, quiet: int, area: bool) -> None:
        place = len(self.stack)
        self.stack.append((tag, quiet, area))
        self.places.setdefault(tag, []).append(place)
        if tag in SCOPE:
            self.scopes.append(place)
        if tag in SCOPE or tag in IMPLIED_END:
            self.ending.append(place)

    def open(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCKS:
            self.write("\n")
        if tag in HEADINGS:
            self.mark("h", HEADINGS[tag])
            self.write("#" * HEADINGS[tag] + " ")
        elif tag == "table":
            self.n_tables += 1
            self.mark("t", self.n_tables)
            self.tables.append([self.n_tables, 0, 0])
        elif tag == "tr" and self.tables:
            self.tables[-1][1:] = [self.tables[-1][1] + 1, 0]
        elif tag in ("td", "th") and self.tables:
            self.tables[-1][2] += 1
            raw = [attributes.get(k) for k in ("rowspan", "colspan")]
            outer = self.tables[-2][0] if len(self.tables) > 1 else None
            self.cells.append([*self.tables[-1], *map(self.span, raw), *raw, tag, "", outer, {}, {}])
            spans = "".join(f"[{k}={' '.join(v.split())}] " for k, v in zip(("rowspan", "colspan"), raw, strict=True) if v not in (None, "1"))
            self.write("| " + spans)
            self.open_cells.append((len(self.cells) - 1, len(self.out)))
        elif tag == "img":
            self.write(" ".join(attributes.get("alt", "").split()))
            url = self.join(attributes.get("src"))
            if attributes.get("src") and url is None:
                self.warnings.append(f"image at line {self.getpos()[0]}: its address cannot be resolved")
            self.images.append((*map(attributes.get, ("src", "alt")), url, *map(attributes.get, ("width", "height", "srcset")), self.getpos()[0]))
        elif tag in STRUCK:
            self.write("~~")
        elif tag == "a":
            raw = attributes.get("href")
            note = NOTE.fullmatch(raw or "")
            href = None if note or not raw or raw.strip().startswith("#") else self.link_of(raw)
            if note:
                self.mark("n", int(note[1]))
                for cell, _ in self.open_cells:
                    self.cells[cell][11][int(note[1])] = None
            self.hrefs.append(None if href is None else (self.links.setdefault(href, len(self.links) + 1), href, len(self.out)))
            if href is not None:
                self.mark("a", (self.links[href], raw, self.stack[-1][2]))

    def join(self, href: str | None) -> str | None:
        if href and href[0] == "/" and self.host and _PLAIN.fullmatch(href) and "//" not in href and "/." not in href:
            return self.host + href
        try:
            return None if href is None else urljoin(self.base, href)
        except ValueError:
            return None

    def link_of(self, href: str) -> str | None:
        full = self.join(href)
        if full is None or self.host and full.startswith(self.host):
            return full
        try:
            return full if urlsplit(full).scheme in self.schemes else None
        except ValueError:
            return None

    @staticmethod
    def span(value: str | None) -> int | None:
        if value is None:
            return 1
        return int(value) if re.fullmatch("[0-9]{1,5}", value) and 1 <= int(value) <= 10_000 else None

    def handle_endtag(self, tag: str) -> None:
        places = self.places.get(tag)
        if places and (tag in SCOPE or not self.scopes or self.scopes[-1] <= places[-1]):
            self.own_end = self.own_end or places[-1] == self.depth and not self.closed
            self.close_to(places[-1])

    def close_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag, quiet, area = self.stack[-1]
            self.closed_areas += area and not self.stack[-2][2] and not self.closed
            if self.depth is not None and len(self.stack) - 1 == self.depth and not self.closed:
                self.closed = True
            elif not quiet and not self.silent():
                self.shut(tag)
            self.stack.pop()
            for places in (self.places[tag], self.scopes, self.ending):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def shut(self, tag: str) -> None:
        if tag in ("td", "th") and self.open_cells:
            cell, begin = self.open_cells.pop()
            parts = [" ".join(p.split()) for p in "".join(t for t, _ in self.out[begin:]).split("\n")]
            self.cells[cell][8] = "\n".join(p for p in parts if p)
            self.replace(begin, " / ".join(p for p in parts if p) + " ")
            return
        if tag == "tr" and self.tables:
            self.write("|")
        elif tag == "table" and self.tables:
            self.tables.pop()
        elif tag in STRUCK:
            self.write("~~")
        elif tag == "a" and self.hrefs:
            self.end_link()
        if tag in BLOCKS:
            self.write("\n")

    def end_link(self) -> None:
        if (link := self.hrefs.pop()) is None:
            return
        number, href, begin = link
        for cell, _ in self.open_cells:
            self.cells[cell][10][number] = None
        if self.link_mode == "references":
            self.write(f" [{number}] ")
        elif self.link_mode == "inline" and (title := page_title(href)):
            label = "".join(t for t, _ in self.out[begin:]).strip()
            self.replace(begin, f"[[{title}]]" if label in ("", title) else f"[[{title}|{label}]]")
        elif self.link_mode == "inline":
            self.write(f" ({href})")
        self.mark("/a", number)

    def handle_data(self, data: str) -> None:
        if self.depth is None and self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        if self.depth is not None and not self.closed and self.stack[-1][1] != RAW and data.strip():
            self.has["text"] = True
        if not self.silent():
            self.write(_SPACES.sub(" ", data))

    def result(self) -> tuple:
        while self.hrefs:  # of a page that is cut in them
            self.end_link()
        kept = [not self.has_area or inside for _, inside in self.out]
        pieces = [p if keep else "" for (p, _), keep in zip(self.out, kept, strict=True)]
        offsets = [*accumulate(map(len, pieces), initial=0)]  # of each piece in the text, and of its end
        lines, begins, shown, following, place = [], [], [], [], 0
        raws = "".join(pieces).splitlines(keepends=True)
        for raw in raws:
            said = raw.strip()
            if said:
                lines.append(" ".join(raw.split()) if said[0] == "|" else said)
            begins.append(place)
            following.append(len(lines) + (not said))  # of a table's boundary, the line behind it
            shown.append(len(lines))  # of a blank line, the line before it
            place += len(raw)
        headings, line_notes, tables, path = [], {}, [], []
        anchors, opened = [], []  # place in out, place of the end, link id, href as written
        for kind, piece, value, source_line in self.marks:
            if kind == "a":
                number, href, inside = value
                opened.append(anchor := [piece, None, number, href])
                if inside or not self.has_area:
                    anchors.append(anchor)
                continue
            if kind == "/a":
                opened.pop()[1] = piece
                continue
            if piece >= len(pieces) or not kept[piece] or not lines:
                continue
            at = bisect_right(begins, offsets[piece]) - 1
            line = max(1, shown[at])
            if kind == "h" and lines[line - 1].startswith("#" * value + " "):
                headings.append((value, line, source_line, lines[line - 1][value + 1 :].strip()))
                path = [h for h in path if h[0] < value] + [headings[-1]]
            elif kind == "t":
                tables.append((value, min(following[at], len(lines)), [h[3] for h in path]))
            elif kind != "h":
                line_notes[line, value] = None
        line_links, originals = {}, {}
        for begin, end, number, href in anchors:
            originals.setdefault(number, {})[href] = None
            if lines:
                for line in self.occupied(raws, begins, shown, offsets[begin], offsets[end]):
                    line_links[line, number] = None
        error = "no_container" if self.depth is None else None if lines else "empty_article"
        if self.depth is not None and not self.own_end:
            self.warnings.append("the container is not closed")
        links = [(i, h, list(originals.get(i, ()))) for h, i in self.links.items()]
        title = "".join(self.title).strip() or None
        refs = [([], []) for _ in lines]
        for which, found in ((0, line_links), (1, line_notes)):
            for line, value in found:
                refs[line - 1][which].append(value)
        return (error, title, lines, headings, links, list(line_links), list(line_notes), [(*c[:10], list(c[10]), list(c[11])) for c in self.cells], self.images,
                self.selector.name if self.depth is not None else None, self.own_end, list(dict.fromkeys(self.warnings)), refs, tables, self.skips,
                (*self.has.values(), self.areas, self.closed_areas))

    @staticmethod
    def occupied(raws: list[str], begins: list[int], shown: list[int], begin: int, end: int) -> list[int]:
        """The lines on which a stretch of the text says something; where it says nothing,
        the line that it stands on or, on a blank one, the last before it."""
        first = at = bisect_right(begins, begin) - 1
        found = []
        if at + 1 < len(begins) and begins[at + 1] < end:
            while at < len(raws) and begins[at] < end:
                if raws[at][max(begin - begins[at], 0) : end - begins[at]].strip():
                    found.append(shown[at])
                at += 1
        return found or ([shown[first]] if shown[first] else [])


NOTHING = (None, [], [], [], [], [], [], [], None, False, [], [], [], [], (False, False, False, 0, 0))


class Reader(HTMLParser):
    """Reads a page once for several parsers; one that fails is told no more."""

    def __init__(self, parsers: list[HTMLParser]):
        super().__init__(convert_charrefs=True)
        self.parsers, self.failed, self.told = list(parsers), {}, parsers
        for p in parsers:
            p.getpos = self.getpos

    def let_go(self) -> None:
        """Without this reader and its parsers hold each other, and what they read stays until cycles are looked for."""
        for p in self.told:
            p.__dict__.pop("getpos", None)

    def fail(self, parser: HTMLParser, e: Exception) -> None:
        """A page must not fail the job; the code says what it was."""
        self.failed[id(parser)] = f"processing_error:{type(e).__name__}"
        self.parsers = [p for p in self.parsers if p is not parser]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for p in self.parsers:
            try:
                p.handle_starttag(tag, attrs)
            except Exception as e:
                self.fail(p, e)

    def handle_endtag(self, tag: str) -> None:
        for p in self.parsers:
            try:
                p.handle_endtag(tag)
            except Exception as e:
                self.fail(p, e)

    def handle_data(self, data: str) -> None:
        for p in self.parsers:
            try:
                p.handle_data(data)
            except Exception as e:
                self.fail(p, e)


@uncollected
def parse_whole(html: str | None, base: str | None, selectors: tuple[Selector, ...], skip=SHIPPED, link_mode: str = "references",
                elements: markup.Elements | None = None) -> tuple:
    """The article of a page, read in one pass; the first of ``selectors`` that the
    page has is its container.  ``elements`` reads the page's elements on the way,
    to the end; without it reading stops behind the container of the first selector."""
    if html is None:
        return ("no_html", *NOTHING)
    if len(html) > MAX_BYTES:
        return ("page_too_large", *NOTHING)
    html = markup.whole_tags(html)
    parsers = [ArticleParser(base or "", s, skip, link_mode) for s in selectors]
    reader = Reader([*parsers, *([elements] if elements else [])])
    error = None
    try:
        for start in range(0, len(html), CHUNK):
            reader.feed(html[start : start + CHUNK])
            if parsers[0].closed and elements is None:  # nothing behind the container is part of it
                break
        else:
            reader.close()
    except (AssertionError, ValueError) as e:  # not markup that can be read on; the elements keep what was read
        error = f"processing_error:{type(e).__name__}"
    reader.let_go()
    n, parser = next(((n, p) for n, p in enumerate(parsers) if p.depth is not None), (len(parsers) - 1, parsers[-1]))
    if error or id(parser) in reader.failed:
        return (error or reader.failed[id(parser)], *NOTHING)
    if n and parser.depth is not None:
        parser.warnings.append(f"{selectors[0].name} is absent, {selectors[n].name} was taken")
    return parser.result()


def parse_page(html: str | None, base: str | None, selectors: tuple[Selector, ...], skip=SHIPPED, link_mode: str = "references") -> tuple:
    """The article of a page, as the fields of ``ARTICLE``."""
    return parse_whole(html, base, selectors, skip, link_mode)


def _as_rows(kind: T.StructType, rows: list[tuple]) -> pd.DataFrame:
    """Tuples in the order of a struct's fields as its rows."""
    found = pd.DataFrame(rows, columns=kind.fieldNames())
    for f in kind:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            names = f.dataType.elementType.fieldNames()
            found[f.name] = [[dict(zip(names, x, strict=True)) for x in xs] for xs in found[f.name]]
        elif isinstance(f.dataType, T.StructType):
            found[f.name] = [dict(zip(f.dataType.fieldNames(), x, strict=True)) for x in found[f.name]]
    return found


def _asked(skip_classes: tuple[str, ...], link_mode: str) -> ElementRules:
    if link_mode not in LINK_MODES:
        raise ValueError(f"link_mode is one of {LINK_MODES}")
    return ElementRules(ad_classes=skip_classes)


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                selectors: tuple[Selector, ...] = (Selector(tag="article"),), skip_classes: tuple[str, ...] = (),
                link_mode: str = "references") -> DataFrame:
    """key, url and article (see ``ARTICLE``) of each page.

    The first selector that fits gives the container.  In it, where there is an
    element of the article's own classes, only these elements' text counts, and
    what ``ElementRules`` (and ``skip_classes``) skip is not read.  Links
    show in the lines as references (by number), inline (as [[title|label]] where
    the address is an article's, else the address in brackets) or off (not at all).
    A link stands on every line that it has text on, so a part of its lines keeps it.
    """
    _asked(skip_classes, link_mode)
    return with_article(pages.select(key, url, html), url, html, selectors, skip_classes, link_mode).select(key, url, "article")


def with_article(pages: DataFrame, url: str = "url", html: str = "html", selectors: tuple[Selector, ...] = (Selector(tag="article"),),
                 skip_classes: tuple[str, ...] = (), link_mode: str = "references") -> DataFrame:
    """``pages`` (all columns) with article, as ``parse_pages`` gives it."""
    skip = _asked(skip_classes, link_mode)

    @by_pieces(ARTICLE, 2)
    def parse(urls: pd.Series, htmls: pd.Series) -> pd.DataFrame:
        return _as_rows(ARTICLE, [parse_page(h, u, selectors, skip, link_mode) for u, h in zip(urls, htmls, strict=True)])

    return pages.withColumn("article", parse.asNondeterministic()(url, html))


#: What ``read_pages`` adds: the article, and all elements of the page.
WHOLE = T.StructType([T.StructField("article", ARTICLE), T.StructField("page", markup.PAGE)])


def read_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               selectors: tuple[Selector, ...] = (Selector(tag="article"),), skip_classes: tuple[str, ...] = (),
               link_mode: str = "references") -> DataFrame:
    """``pages`` (all columns) with article and page (see ``ARTICLE`` and
    ``markup.PAGE``), both from one reading of the html: lines, links, tables and
    audits come from the one, notes and metadata from the other."""
    skip = _asked(skip_classes, link_mode)

    @by_pieces(WHOLE, 2)
    def read(urls: pd.Series, htmls: pd.Series) -> pd.DataFrame:
        found, elements = [], []
        for u, h in zip(urls, htmls, strict=True):
            parser = markup.Elements()
            found.append(parse_whole(h, u, selectors, skip, link_mode, parser))
            text, rows = parser.result() if h is not None else (None, [])
            elements.append(markup.as_page(text, rows))
        return pd.DataFrame({"article": _as_rows(ARTICLE, found).to_dict("records"), "page": elements})

    whole = pages.withColumn("_whole", read.asNondeterministic()(url, html))
    return whole.select(*[F.col(f"`{c}`") for c in pages.columns], F.col("_whole.article").alias("article"), F.col("_whole.page").alias("page"))


def lines(articles: DataFrame, key: str = "page_id") -> DataFrame:
    """key, line and text of every line."""
    found = articles.select(key, F.posexplode("article.lines").alias("line", "text"))
    return found.select(key, (F.col("line") + 1).cast("long").alias("line"), "text")


def child(articles: DataFrame, part: str, key: str = "page_id") -> DataFrame:
    """headings, links, line_links, cells or images as a table of their own."""
    return articles.select(key, F.inline(f"article.{part}"))


def linked(articles: DataFrame, key: str = "page_id") -> DataFrame:
    """key, link_id, n_lines and original_hrefs of each link that lines hold: on how many it
    stands, and how it is written.  A page is one row, so its links are counted in it:
    sorted, equal ones stand together."""
    page = articles.select(key, F.array_sort(F.transform("article.line_links", lambda x: x["link_id"])).alias("_ids"), F.col("article.links").alias("_links")).where("size(_ids) > 0")
    of = lambda i: F.element_at("_ids", i)
    page = page.withColumn("_begins", F.filter(F.sequence(F.lit(1), F.size("_ids")), lambda i: (i == 1) | (of(i) != of(F.greatest(i - 1, F.lit(1))))))
    after = lambda i: F.coalesce(F.try_element_at("_begins", i + 2), F.size("_ids") + 1)
    # links are numbered in the order in which they are listed
    found = lambda b, i: F.struct(
        of(b).alias("link_id"), (after(i) - b).cast("long").alias("n_lines"), F.element_at("_links", of(b).cast("int"))["original_hrefs"].alias("original_hrefs"))
    return page.select(key, F.inline(F.transform("_begins", found)))


def with_metadata(pages: DataFrame) -> DataFrame:
    """``pages`` with last_updated, categories and tags from the column page."""
    first = lambda fits: F.try_element_at(F.filter("page.elements", fits), F.lit(1))
    updated = first(lambda e: (e["tag"] == "p") & F.array_contains(markup.classes(e), "update"))
    block = lambda name: first(lambda e: (e["tag"] == "ul") & (markup.attribute(e, "id") == name))
    page = pages.withColumn("_updated", updated).withColumn("_categories", block("page-category")).withColumn("_tags", block("page-tags"))

    def items(name: str) -> Column:
        inside = F.slice("page.elements", F.coalesce(F.col(f"{name}.node") + 1, F.lit(1)), F.coalesce(F.col(f"{name}.last") - F.col(f"{name}.node"), F.lit(0)))
        rows = F.filter(inside, lambda e: (e["tag"] == "li") & ~F.array_contains(markup.classes(e), "title"))
        return F.array_distinct(F.filter(F.transform(rows, lambda e: markup.text_of(e)), lambda t: t != ""))

    none = F.array().cast("array<string>")
    said = F.trim(F.regexp_replace(markup.text_of(F.col("_updated")), r"^最終更新\s*[:：]?\s*", ""))
    found = page.withColumn("last_updated", F.nullif(said, F.lit(""))).withColumn("categories", F.coalesce(items("_categories"), none)).withColumn("tags", F.coalesce(items("_tags"), none))
    return found.drop("_updated", "_categories", "_tags")


def metadata(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, last_updated, categories and tags: the first of each block of a page, which
    ``read_pages`` has read or which is read here."""
    return with_metadata(markup.read(pages, key, html)).select(key, "last_updated", "categories", "tags")


def article_state(article: Column) -> Column:
    """text; empty (the container and its areas end and hold nothing); no_extractable_text
    (media, or text that is not shown); or error, as for forms alone."""
    content = article["content"]
    shut = (article["error_code"] == "empty_article") & article["closed"] & (content["areas"] == content["closed_areas"])
    held = content["has_text"] | content["has_media"]
    return (
        F.when(F.size(article["lines"]) > 0, "text")
        .when(shut & held, "no_extractable_text")
        .when(shut & ~content["has_forms"], "empty")
        .otherwise("error")
    )


def empty_state(articles: DataFrame) -> DataFrame:
    """``articles`` with article_state."""
    return articles.withColumn("article_state", article_state(F.col("article")))
