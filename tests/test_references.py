"""Character references by context, against a walk over the page character by character."""

import random
import re
from html.parser import HTMLParser

import pytest

from sparquill.functions import references

PAIR = "&#xD83D;&#xDE00;"


@pytest.mark.parametrize(("html", "counts", "joined"), [
    (f"a{PAIR}b", (1, 1, 0, 0), "a😀b"), (f"<p title='{PAIR}' data-x='{PAIR}'>", (1, 1, 0, 0), f"<p title='😀' data-x='{PAIR}'>"), (f"<script title='{PAIR}'>{PAIR}</script>{PAIR}", (1, 1, 0, 0), f"<script title='{PAIR}'>{PAIR}</script>😀"),
    (f"<style>{PAIR}", (0, 0, 0, 0), f"<style>{PAIR}"), (f"<!-- {PAIR} -->{PAIR}", (1, 1, 0, 0), f"<!-- {PAIR} -->😀"), (f"<a href={PAIR}>", (0, 0, 0, 0), f"<a href={PAIR}>"),
    ("&#xD83D;x&#xDE00;", (0, 0, 2, 0), None), ("&#xDE00;&#xD83D;", (0, 0, 2, 0), None), ("&#xD83D;&#xD83D;&#xDE00;", (1, 1, 1, 0), "&#xD83D;😀"), ("&#xD83D&#xDE00;", (0, 0, 2, 0), None), ("&#xD83D;&#xDE00", (0, 0, 2, 0), None),
    ("&#" + "0" * 200 + "65;", (0, 0, 0, 1), "&#65;"), ("&#" + "9" * 5000 + ";", (0, 0, 0, 1), "&#1114112;"), ("<a href='&#" + "0" * 200 + "65'>", (0, 0, 0, 1), "<a href='&#65;'>"), ("&#x" + "0" * 300 + "41;", (0, 0, 0, 0), None),
    ("plain &amp; &#65;", (0, 0, 0, 0), None), ("", (0, 0, 0, 0), None), (f"<p alt='{PAIR}", (1, 1, 0, 0), "<p alt='😀"),
])
def test_cases(html, counts, joined):
    found = references.prepare(html, "utf16")
    assert found[1:5] == counts and found[0] == (joined or html)
    kept = references.prepare(html, "html")
    assert kept[1] == counts[0] and kept[2] == 0 and (kept[0] == html or counts[3])


def walked(html):
    """joined text and counts by a parser of its own kind: the standard one, told of each reference."""

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.refs, self.raw = [], None  # (place, text of the reference) and breaks as None

        def place(self):
            line, column = self.getpos()
            return sum(len(x) + 1 for x in html.split("\n")[: line - 1]) + column

        def handle_charref(self, name):
            if not self.raw:
                at = self.place()
                self.refs.append((at, re.match(r"&#(?:[xX][0-9a-fA-F]+|[0-9]+);?", html[at:])[0]))

        def handle_starttag(self, tag, attrs):
            self.raw = tag if tag in ("script", "style") else None

        def handle_endtag(self, tag):
            self.raw = None if tag == self.raw else self.raw

    walk = Walk()
    walk.feed(html)
    walk.close()
    pairs = unpaired = i = 0
    refs = walk.refs
    number = lambda r: int(r[2:].rstrip(";")[1:], 16) if r[2] in "xX" else int(r[2:].rstrip(";"))
    while i < len(refs):
        at, r = refs[i]
        after = refs[i + 1] if i + 1 < len(refs) and refs[i + 1][0] == at + len(r) else None
        if 0xD800 <= number(r) <= 0xDBFF and r.endswith(";") and after and after[1].endswith(";") and 0xDC00 <= number(after[1]) <= 0xDFFF:
            pairs, i = pairs + 1, i + 2
            continue
        unpaired += 0xD800 <= number(r) <= 0xDFFF
        i += 1
    return pairs, unpaired


def test_text_equals_a_walk():
    random_ = random.Random(12)
    bits = ["&#xD83D;", "&#xDE00;", "&#55357;", "&#56832;", "&#xD83D", "x", "\n", "<b>", "</b>", "<script>", "</script>", "<!-- ", " -->", "&#65;", " ", "<p class='a b'>"]
    for _ in range(600):
        html = "".join(random_.choices(bits, k=random_.randint(1, 25))) + " x"
        if re.search(r"<!-- (?!.* -->)|<script>(?!.*</script>)|<!-- (?:(?! -->).)*<script>|<script>(?:(?!</script>).)*<!--", html, re.S):
            continue  # what is never closed is read in several ways
        assert references.prepare(html, "utf16")[1:4:2] == walked(html), html


def test_samples_are_bounded_and_pages_without_references_pass(spark):
    pages = spark.createDataFrame([(1, "\n&#xD800;" * 50), (2, "plain"), (3, None), (4, f"x\n{PAIR}")], "page_id long, html string")
    got = {r["page_id"]: r for r in references.prepared(pages).collect()}
    first = got[1]["references"]
    assert (first["unpaired"], len(first["samples"]), first["truncated"]) == (50, 40, True)
    assert (first["samples"][1]["line"], first["samples"][1]["offset"], first["samples"][1]["context"]) == (3, 10, "text")
    assert got[2]["html"] == "plain" and got[3]["html"] is None and got[4]["html"] == f"x\n{PAIR}" and got[4]["references"]["eligible_pairs"] == 1
    assert {r["page_id"]: r["html"] for r in references.prepared(pages, mode="utf16").collect()}[4] == "x\n😀"
    with pytest.raises(ValueError):
        references.prepared(pages, mode="other")
