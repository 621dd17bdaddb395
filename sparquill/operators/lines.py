"""Numbered lines of documents: literal search, context, paging.

``lines`` tables hold a key, ``line`` (1, 2, ... without gaps) and ``text``.
A document is one row, so context and pages are worked out inside it, on the
array of its lines: only the lines that are asked for become rows, and nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.pieces import by_pieces
from sparquill.functions.text import lines_of


def number_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each line that is not blank.  Numbers come with the split, so
    nothing is shuffled."""
    found = docs.select(key, F.posexplode(lines_of(F.col(text))).alias("line", "text"))
    return found.select(key, (F.col("line") + 1).cast("long").alias("line"), "text")


def find(lines: DataFrame, literal: str) -> DataFrame:
    """Lines that hold ``literal`` as it stands."""
    if not literal.strip():
        raise ValueError("the literal to find is blank")
    return lines.where(F.contains("text", F.lit(literal)))


def _rows(numbers: Column, all_lines: str = "_lines", *more: Callable[[Column], Column]) -> Column:
    """line and text of the given line numbers, and what ``more`` says of a number."""
    return F.transform(numbers, lambda i: F.struct(i.cast("long").alias("line"), F.element_at(all_lines, i).alias("text"), *[m(i) for m in more]))


def _hits(literal: str, all_lines: str = "_lines") -> Column:
    """Numbers of the lines that hold ``literal``."""
    return F.filter(F.transform(all_lines, lambda x, i: F.when(F.contains(x, F.lit(literal)), i + 1)), lambda i: i.isNotNull())


def _near(hits: str, around: int, all_lines: str = "_lines") -> Column:
    """Numbers of the lines within ``around`` of a hit, in order."""
    frames = F.transform(hits, lambda h: F.sequence(F.greatest(h - around, F.lit(1)), F.least(h + around, F.size(all_lines))))
    return F.array_distinct(F.flatten(frames))


def _held(docs: DataFrame, key: str, literal: str, text: str, split: Callable[[Column], Column]) -> DataFrame:
    """key, _lines and _hits of the documents that hold ``literal`` at all."""
    if not literal.strip():
        raise ValueError("the literal to find is blank")
    kind = docs.schema[text].dataType.simpleString()
    body = F.col(text) if kind == "string" else F.array_join(text, "\n")
    some = docs.where(F.contains(body, F.lit(literal)))
    return some.select(key, split(F.col(text)).alias("_lines")).select(key, "_lines", _hits(literal).alias("_hits"))


def with_context(docs: DataFrame, key: str, literal: str, around: int, text: str = "text", split: Callable[[Column], Column] = lines_of) -> DataFrame:
    """key, line and text of the lines within ``around`` lines of one that holds
    ``literal``.  ``split`` makes the array of lines of the column ``text``."""
    held = _held(docs, key, literal, text, split)
    near = held.select(key, "_lines", _near("_hits", around).alias("_near"))
    return near.select(key, F.inline(_rows(F.col("_near"))))


def page(docs: DataFrame, key: str, start: int, count: int, text: str = "text", split: Callable[[Column], Column] = lines_of) -> DataFrame:
    """``count`` lines from number ``start``, with flags for more of them."""
    whole = docs.select(key, split(F.col(text)).alias("_lines"))
    cut = whole.select(key, F.size("_lines").alias("_total"), F.slice("_lines", start, count).alias("_shown"))
    return cut.select(key, "_total", F.posexplode("_shown").alias("_at", "text")).select(
        key, (F.col("_at") + start).cast("long").alias("line"), "text",
        F.lit(start > 1).alias("more_before"), (F.lit(start + count - 1) < F.col("_total")).alias("more_after"),
    )


def page_of_matches(docs: DataFrame, key: str, literal: str, around: int, start: int, count: int, text: str = "text",
                    split: Callable[[Column], Column] = lines_of) -> DataFrame:
    """From match number ``start``, lines near matches, ``count`` of them at most.

    Lines up to the match before the first do not come back as its context, and
    the page moves on until the first match is on it.  Columns: key, line, text,
    match_offset, more_before, more_after, more_matches.
    """
    held = _held(docs, key, literal, text, split)
    near = held.select(key, "_lines", "_hits", _near("_hits", around).alias("_near"))
    first = F.try_element_at("_hits", F.lit(start))
    before = F.coalesce(F.try_element_at("_hits", F.lit(start - 1)), F.lit(0)) if start > 1 else F.lit(0)
    placed = near.select(key, "_lines", "_hits", "_near", first.alias("_first"), F.greatest(first - around, before + 1).alias("_floor"))
    begin = F.greatest(
        F.size(F.filter("_near", lambda i: i < F.col("_floor"))) + 1, F.array_position("_near", F.col("_first")).cast("int") - count + 1
    )
    shown = placed.select(key, "_lines", "_hits", "_near", begin.alias("_begin"), F.slice("_near", F.coalesce(begin, F.lit(1)), F.when(F.col("_first").isNotNull(), count).otherwise(0)).alias("_shown"))
    return shown.select(
        key, F.lit(start).cast("long").alias("match_offset"), (F.col("_begin") > 1).alias("more_before"),
        (F.col("_begin") + count - 1 < F.size("_near")).alias("more_after"),
        (F.array_max("_hits") > F.array_max("_shown")).alias("more_matches"), F.inline(_rows(F.col("_shown"))),
    ).select(key, "line", "text", "match_offset", "more_before", "more_after", "more_matches")


def cut_lines(text: str, limit: int) -> list[str]:
    bodies, start = [], 0
    while len(text) - start > limit:
        end = text.rfind("\n", start, start + max(limit, 0) + 1)  # of the last line that fits, else of the first
        end = text.find("\n", start) if end < 0 else end
        if end < 0:
            break
        bodies.append(text[start:end])
        start = end + 1
    return [*bodies, text[start:]]


def parts(docs: DataFrame, key: str, limit: int = 15_000, text: str = "text") -> DataFrame:
    """key, part and body: documents cut between lines into parts of at most
    ``limit`` characters, as full as they can be in order; a longer line is a
    part of its own.  Joined by line feeds the parts give the document again.

    Where a part ends depends on all parts before it, so a pandas UDF goes
    through each document's lines once.
    """
    return docs.select(key, F.posexplode(cut_column(text, limit)).alias("part", "body")).select(key, (F.col("part") + 1).cast("long").alias("part"), "body")


def cut_column(text: str, limit: int) -> Column:
    """The bodies of a text's parts."""

    @by_pieces(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_lines(t, limit), na_action="ignore")

    return cut.asNondeterministic()(text)
