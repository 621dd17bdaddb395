"""Numeric character references of a page, by where they stand: halves of surrogate
pairs joined on request, lone ones counted, very long ones written short."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.pieces import by_pieces

# Characters of a decimal reference from which it is written anew, samples of a page, and their length.
LONGEST, SAMPLES, SHOWN = 128, 40, 160
MODES = ("html", "utf16")
PAIRED_ATTRIBUTES = frozenset(("title", "alt"))

REFERENCE = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+))(;?)")
#: Comments, declarations, end tags, start tags with their attributes.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</[a-zA-Z][^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'/=>][^\s/=>]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in ("script", "style")}

REPORT = T.StructType([
    T.StructField("html", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("eligible_pairs", "joined_pairs", "unpaired", "normalized")],
    T.StructField("samples", T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("before", "after", "action", "context")], *[T.StructField(n, T.LongType()) for n in ("offset", "line")]]))),
    T.StructField("truncated", T.BooleanType()),
])


def contexts(html: str) -> Iterator[tuple[int, int, str, bool]]:
    """start, end, context and whether pairs count there: runs of text, and values of
    attributes; scripts, styles, comments and the markup itself are left out."""
    at = 0
    while at < len(html):
        tag = MARKUP.search(html, at)
        start = tag.start() if tag else len(html)
        if start > at:
            yield at, start, "text", True
        if not tag:
            return
        at = tag.end()
        if not tag[1]:
            continue
        raw = RAW_END.get(tag[1].lower())
        for a in ATTRIBUTE.finditer(html, tag.start(2), tag.end(2)):
            group = next(g for g in (2, 3, 4) if a[g] is not None)
            name = a[1].lower()
            yield a.start(group), a.end(group), f"attribute:{name}", raw is None and name in PAIRED_ATTRIBUTES
        if raw:
            end = raw.search(html, at)
            at = end.start() if end else len(html)


def value_of(reference: re.Match) -> int:
    """The code point, or one beyond all for numbers that are too large to be one."""
    digits = (reference[1] or reference[2]).lstrip("0") or "0"
    return 0x110000 if len(digits) > 7 else int(digits, 16 if reference[1] else 10)


def prepare(html: str | None, mode: str = "html") -> tuple:
    """The fields of ``REPORT``: html as it is to be parsed, and what was found.

    A pair is two references to the halves of one character, each with its
    semicolon, one right behind the other, in text or in a title or alt.  Mode utf16
    joins it; html leaves it, as every other half, to become U+FFFD.  Decimal
    references of more than LONGEST characters are written short in both modes."""
    if html is None:
        return (None, 0, 0, 0, 0, [], False)
    counts = dict.fromkeys(("eligible_pairs", "joined_pairs", "unpaired", "normalized"), 0)
    parts, done, samples, total, line, seen = [], 0, [], 0, 1, 0

    def note(start: int, end: int, after: str, action: str, context: str) -> None:
        nonlocal total, line, seen
        total += 1
        if len(samples) < SAMPLES:
            line, seen = line + html.count("\n", seen, start), start
            samples.append((html[start:end][:SHOWN], after, action, context, start, line))

    def put(start: int, end: int, new: str) -> None:
        nonlocal done
        parts.extend((html[done:start], new))
        done = end

    def shorten(m: re.Match, value: int, context: str) -> None:
        if m[2] and len(m[2]) > LONGEST:
            counts["normalized"] += 1
            put(m.start(), m.end(), f"&#{value};")
            note(m.start(), m.end(), f"&#{value};", "equivalent_decimal_syntax", context)

    for start, end, context, pairs in contexts(html):
        found = list(REFERENCE.finditer(html, start, end))
        i = 0
        while i < len(found):
            m, value = found[i], value_of(found[i])
            low = found[i + 1] if i + 1 < len(found) and found[i + 1].start() == m.end() else None
            if pairs and 0xD800 <= value <= 0xDBFF and m[3] and low and low[3] and 0xDC00 <= value_of(low) <= 0xDFFF:
                counts["eligible_pairs"] += 1
                if mode == "utf16":
                    counts["joined_pairs"] += 1
                    glyph = chr(0x10000 + (value - 0xD800 << 10) + value_of(low) - 0xDC00)
                    put(m.start(), low.end(), glyph)
                    note(m.start(), low.end(), glyph, "joined_utf16_pair", context)
                else:
                    shorten(m, value, context)
                    shorten(low, value_of(low), context)
                i += 2
                continue
            if pairs and 0xD800 <= value <= 0xDFFF:
                counts["unpaired"] += 1
                note(m.start(), m.end(), "�", "left_for_standard_html_replacement", context)
            shorten(m, value, context)
            i += 1
    return ("".join([*parts, html[done:]]), *counts.values(), samples, total > SAMPLES)


#: An ampersand that begins no reference with a semicolon.
BARE = "&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)"


def closed_only(html: Column) -> Column:
    """html in which a reference counts only with its semicolon; HTML itself also
    reads some without one, as in a text that was cut behind ``&amp``."""
    return F.regexp_replace(html, BARE, "&amp;")


#: Pages without any such reference need not leave the JVM.
TELLTALE = rf"&#0*(?:5[5-7][0-9]{{3}})|&#[xX]0*[dD][89a-fA-F]|&#[0-9]{{{LONGEST + 1}}}"


def report(html: Column, mode: str = "html") -> Column:
    """A column of ``REPORT`` for a column of html (nulls where there is nothing to report)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    names = REPORT["samples"].dataType.elementType.fieldNames()

    @by_pieces(REPORT)
    def read(pages: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([prepare(h, mode) for h in pages], columns=REPORT.fieldNames())
        found["samples"] = [[dict(zip(names, s, strict=True)) for s in rows] for rows in found["samples"]]
        return found

    return read.asNondeterministic()(F.when(html.rlike(TELLTALE), html))


def prepared(pages: DataFrame, html: str = "html", mode: str = "html") -> DataFrame:
    """``pages`` with html as it is to be parsed, and references: the report without it."""
    rows = pages.withColumn("_report", report(F.col(html), mode))
    kept = [f for f in REPORT.fieldNames() if f != "html"]
    return rows.withColumn(html, F.coalesce("_report.html", html)).withColumn("references", F.struct(*[F.col(f"_report.{f}").alias(f) for f in kept])).drop("_report")
