"""Main text of web pages by the consensus of each host's pages.

Every page scores its containers, climbs from the best one to what holds the
whole article, and votes for that one's tag-class path, with runs of digits generalised.  Votes are summed per host and path in
Spark; the path with most votes wins, and every page of the host is extracted
again from the containers on that path (or, lacking them, from its own best).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lower_ascii, staged

# Tags by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
BOILERPLATE_TAGS = frozenset(
    "aside button canvas dialog footer form head header iframe input label menu nav noscript object option script select style svg"
    " template textarea title".split()
)
HEADINGS = ("h1", "h2", "h3")
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related"
    " respond share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget"
    " commentarea commentbox commentform commentlist commentsection discussion discussions replies reply usercomments".split()
)
# A class or id with such a word tells a state, not what the element is for; the others name what holds an article.
STATE_WORDS = frozenset("allowed closed disabled enabled free has hide is no off on open with without".split())
ARTICLE_WORDS = frozenset("article content entry hentry main page post story text".split())
# Open elements of the first kind end where one of the second begins.
ENDED_BY = {
    "p": BLOCK - {"body", "head", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "option": frozenset({"option"}),
}
# An end tag or an implied end does not reach beyond these.
WALLS = frozenset("article aside body div footer form header html main nav section table td th ul ol dl".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""", re.S)
# One attribute after the other, so that a value never counts as a name.
ATTRIBUTE = re.compile(r"""([^\s"'/=>][^\s/=>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
ROOT = 0


class Page:
    """A light tree: per node its tag, path, parent and whether it is
    boilerplate; texts and block boundaries in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.drop = [""], [ROOT], [False]
        self.soft = [""]  # why a node may be boilerplate: form, header or named; "hard" for what always is
        #: Nearest container and block around a node, and whether it is in a link below that container.
        self.home, self.block, self.linked = [ROOT], [ROOT], [False]
        #: Paths are numbered: of each node, and of each step below a path; steps with the path above.
        self.paths, self.below, self.steps = [0], {}, [(0, "")]
        self.flow: list[tuple[int, str | None]] = []  # (node, text); None: a block begins or ends; " ": line break
        self.stack = [ROOT]
        #: Places in the stack: of each tag, of walls, and of what may end without an end tag.
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.ending: list[int] = []
        at = 0
        while True:
            m = TAG.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                self.flow.append((self.stack[-1], text))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                opened = self._start(tag, m[3])
                if tag in RAW and opened:
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._cut(len(self.stack) - 1)
        self._settle()

    def _start(self, tag: str, attributes: str) -> bool:
        """Whether the element is open now."""
        while self.ending and tag in ENDED_BY.get(self.tags[self.stack[self.ending[-1]]], ()):
            self._cut(self.ending[-1])
        names, closed = {}, attributes.endswith("/")
        if attributes:
            for found in ATTRIBUTE.finditer(attributes):
                names.setdefault(found[1].lower(), (found[2] or found[3] or found[4] or "").lower())
                closed = closed and not (found[4] and found.end() == len(attributes))  # a last "/" may belong to a value
        parent, node = self.stack[-1], len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        step = re.sub(r"\d+", "0", ".".join([tag, *names.get("class", "").replace(">", "").split()]))
        above = self.paths[parent]
        if (above, step) not in self.below:
            self.below[above, step] = len(self.steps)
            self.steps.append((above, step))
        self.paths.append(self.below[above, step])
        container = tag in CONTAINERS
        self.home.append(node if container else self.home[parent])
        self.linked.append(not container and (tag == "a" or self.linked[parent]))
        self.block.append(node if tag in BLOCK else self.block[parent])
        self.soft.append(self._kind(tag, names))
        if tag in BLOCK:
            self.flow.append((node, None))
        elif tag == "br":
            self.flow.append((parent, " "))
        if opens := tag not in VOID and not closed:
            place = len(self.stack)
            self.stack.append(node)
            self.places.setdefault(tag, []).append(place)
            if tag in WALLS:
                self.walls.append(place)
            if tag in WALLS or tag in ENDED_BY:
                self.ending.append(place)
        return opens

    @staticmethod
    def _kind(tag: str, names: dict[str, str]) -> str:
        if tag in ("html", "body", "article", "main"):
            return ""
        if "hidden" in names or names.get("aria-hidden") == "true" or names.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search"):
            return "hard"
        if NOT_SHOWN.search(names.get("style", "")):
            return "hard"
        if tag in ("form", "header"):
            return tag
        if tag in BOILERPLATE_TAGS:
            return "hard"
        if not names:
            return ""
        named = article = False
        for token in f"{names.get('class', '')} {names.get('id', '')}".split():
            words = set(re.split(r"[^a-z]+", token))
            if BOILERPLATE_WORDS.isdisjoint(words):
                article = article or not ARTICLE_WORDS.isdisjoint(words)
            elif STATE_WORDS.isdisjoint(words):
                named = True
        return "named" if named and not article else ""

    def _cut(self, place: int) -> None:
        """Closes what is open from this place of the stack on."""
        while len(self.stack) > place:
            self.places[self.tags[self.stack.pop()]].pop()
        for places in (self.walls, self.ending):
            while places and places[-1] >= place:
                places.pop()

    def _end(self, tag: str) -> None:
        if places := self.places.get(tag):
            if tag in WALLS or not self.walls or self.walls[-1] <= places[-1]:
                self._cut(places[-1])
        if tag in BLOCK:
            self.flow.append((self.stack[-1], None))

    def _settle(self) -> None:
        """What is boilerplate, once it is known what each element holds.

        A form or an element named like boilerplate that holds an article or main
        stays, as does a form around most of the page's text, and an article's
        own header if it holds a heading."""
        n = len(self.tags)
        hard, inside = [False] * n, [False] * n
        for i in range(1, n):
            up = self.parents[i]
            hard[i] = hard[up] or self.soft[i] == "hard"
            inside[i] = inside[up] or self.tags[up] in ("article", "main")
        size, whole, headed = [0] * n, [False] * n, [False] * n
        for i, text in self.flow:
            if text and not hard[i]:
                size[i] += len(text.strip())
        for i in range(n - 1, 0, -1):  # children come after their parents
            up = self.parents[i]
            size[up] += size[i]
            whole[up] = whole[up] or whole[i] or self.tags[i] in ("article", "main")
            headed[up] = headed[up] or headed[i] or self.tags[i] in HEADINGS
        for i in range(1, n):
            kind = self.soft[i]
            stays = (
                not kind
                or kind == "header" and inside[i] and headed[i]
                or kind in ("form", "named") and whole[i]
                or kind == "form" and 2 * size[i] > size[ROOT]
            )
            self.drop.append(self.drop[self.parents[i]] or not stays)

    def path(self, node: int) -> str:
        steps, number = [], self.paths[node]
        while number:
            number, step = self.steps[number]
            steps.append(step)
        return ">".join(steps[::-1])

    def gains(self) -> list[float]:
        """Of containers: text in their own paragraphs, less text in links."""
        gain = [0.0] * len(self.tags)
        for node, text in self.flow:
            if text and not self.drop[node]:
                length = len(text.strip())
                gain[self.home[node]] += -length if self.linked[node] else length
        return gain

    def scores(self, gain: list[float]) -> dict[int, float]:
        """Of containers: what they gain, half of it passed to the container above."""
        share = gain[:]
        for node in range(len(gain) - 1, 0, -1):  # children come after their parents
            share[self.parents[node]] += share[node] / 2
        return {n: share[n] for n in range(1, len(gain)) if self.tags[n] in CONTAINERS and share[n] > 0 and not self.drop[n]}

    def best(self) -> int:
        gain = self.gains()
        scores = self.scores(gain)
        return self.climbed(max(scores, key=lambda n: (scores[n], -n)), gain) if scores else ROOT

    def climbed(self, node: int, gain: list[float]) -> int:
        """The outermost article or main around ``node``; without one, the
        outermost ancestor below body with more text than links elsewhere in
        it.  If that has no h1, the nearest ancestor that has one."""
        above = [node]
        while above[-1] != ROOT:
            above.append(self.parents[above[-1]])
        held = [max(g, 0.0) for g in gain]
        headed = [False] * len(self.tags)
        for n, text in self.flow:
            if text and not self.drop[n] and text.strip():
                n = self.block[n]
                headed[n] = headed[n] or self.tags[n] == "h1"
        for n in range(len(held) - 1, 0, -1):
            held[self.parents[n]] += held[n]
            headed[self.parents[n]] = headed[self.parents[n]] or headed[n]
        if whole := [n for n in above if self.tags[n] in ("article", "main")]:
            node = whole[-1]
        else:
            for n in above:
                if n == ROOT or self.tags[n] in ("body", "html"):
                    break
                if held[n] > held[node]:
                    node = n
        if headed[node]:
            return node
        return next((n for n in above[above.index(node) :] if headed[n]), node)

    def nodes_on(self, path: str) -> list[int]:
        number = 0
        for step in path.split(">"):
            number = self.below.get((number, step), -1)
        return [n for n in range(1, len(self.tags)) if self.paths[n] == number and not self.drop[n]]

    def text(self, chosen: list[int]) -> str:
        inside, of = [ROOT in chosen] * len(self.tags), set(chosen)
        for n in range(1, len(self.tags)):
            inside[n] = n in of or inside[self.parents[n]]
        blocks, parts = [], []
        for node, text in [*self.flow, (ROOT, None)]:
            if text is None:
                block = " ".join(html.unescape("".join(parts)).split())
                if block:
                    blocks.append(block)
                parts = []
            elif inside[node] and not self.drop[node]:
                parts.append(text)
        return "\n\n".join(blocks)


def votes(pages: DataFrame) -> DataFrame:
    """host, path and votes: each page's best container, if it has any."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                if (best := page.best()) != ROOT:
                    hosts.append(host)
                    paths.append(page.path(best))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])
        give_back()

    rows = pages.select(host_of_page().alias("host"), "html").mapInArrow(vote, "host string, path string")
    return rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))


def host_of_page():
    return F.coalesce(lower_ascii(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text for each row of ``pages``.

    Null and empty html gives an empty text.  Pages without a host (null url)
    vote together.  Equal votes go to the smaller path.  Repeated rows vote and
    are extracted each; pages of any length are read whole; an empty table gives
    no rows; other columns are ignored.  Hosts' winning paths are
    one small row per host, held against pages by a join that Spark broadcasts
    when the staged table is small and splits by skew otherwise.
    """
    winner = staged(
        votes(pages).groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path")).withColumnRenamed("host", "_host"), "host-paths"
    )
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
                page = Page(source or "")
                texts.append(page.text((page.nodes_on(path) if path else []) or [page.best()]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])
        give_back()

    rows = pages.select("page_id", "url", "html", host_of_page().alias("_own_host"))
    joined = rows.join(winner, F.col("_own_host") == F.col("_host"), "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string")
