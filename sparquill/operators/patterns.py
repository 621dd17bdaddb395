"""Many literal patterns at once: one automaton for a whole table of them.

Texts are gone through once however many patterns there are.  The automaton is
broadcast, so its patterns are held to BLOCK_BYTES as measured; a larger table is
worked off in blocks of that size, each with an automaton of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of patterns, as UTF-8, in one automaton.
BLOCK_BYTES = 8 << 20
#: Rows that are gone through at once.
ROWS = 1024


def blocks(patterns: DataFrame, largest: int | None = None) -> Iterator[list[str]]:
    """The distinct patterns in lists of ``largest`` bytes at most (or of one
    pattern); one list is on the driver at a time."""
    largest = largest or BLOCK_BYTES
    distinct = patterns.select("pattern").where("pattern <> ''").distinct()
    n = 1
    while True:
        block = F.pmod(F.xxhash64("pattern", F.lit(n)), F.lit(n))
        sizes = distinct.groupBy(block.alias("b")).agg(F.sum(F.octet_length("pattern")).alias("size"), F.count(F.lit(1)).alias("rows"))
        if not sizes.where((F.col("size") > largest) & (F.col("rows") > 1)).head(1):
            break
        n *= 2
    for b in range(n):
        yield [r["pattern"] for r in distinct.where(block == b).orderBy("pattern").collect()]


def word_sign(c: str) -> bool:
    return c == "_" or c.isascii() and c.isalnum()


def occurrences(rows: DataFrame, patterns: DataFrame, text: str = "text", whole_words: bool = False, largest: int | None = None, with_text: bool = True) -> DataFrame:
    """``rows`` with pattern and n for each of ``patterns`` (pattern) that a text
    holds: how many times, places that overlap included.

    With ``whole_words`` a place counts only if neither sign beside it is an ASCII
    letter, digit or underscore.  Without ``with_text`` the text itself is left out,
    which would come back from Python once for each pattern.  Null texts and patterns, and empty ones, hold and
    are nothing."""
    found, kept_columns = [], [f for f in rows.schema if with_text or f.name != text]
    for some in blocks(patterns, largest):
        if not some:
            continue
        automaton = ahocorasick.Automaton()
        for p in some:
            automaton.add_word(p, p)
        automaton.make_automaton()
        shared = rows.sparkSession.sparkContext.broadcast(automaton)
        names = [f.name for f in kept_columns]

        def search(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
                at, held, counts = [], [], []
                for i, value in enumerate(batch.column(text).to_pylist()):
                    own: dict[str, int] = {}
                    for end, p in shared.value.iter(value or ""):
                        start = end - len(p) + 1
                        if whole_words and (start and word_sign(value[start - 1]) or end + 1 < len(value) and word_sign(value[end + 1])):
                            continue
                        own[p] = own.get(p, 0) + 1
                    at += [i] * len(own)
                    held += own.keys()
                    counts += own.values()
                kept = batch.select(names).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(held, pa.string()), pa.array(counts, pa.int64())], [*names, "pattern", "n"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns)
        found.append(rows.mapInArrow(search, f"{kinds}, pattern string, n long"))
    if not found:
        return rows.limit(0).select(*[f"`{f.name}`" for f in kept_columns], F.lit("").alias("pattern"), F.lit(0).cast("long").alias("n"))
    return reduce(DataFrame.union, found)
