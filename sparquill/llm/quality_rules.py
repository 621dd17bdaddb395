"""Quality rules with thresholds learnt per language and source.

Each text gets a few counts.  Their ratios go into mergeable KLL quantile
sketches, one per (lang, source), and merged ones per language.  A group's
fences are those of its own sketch and its language's, weighted by its rows; rows join their group's fences.

Word lengths lie around their median, and their fences are so many spreads away
from it.  Symbols, repeated lines and repeated words are 0 or near it in most
texts: there the sketch is read upwards from the median.  If its quantiles leap
from what the bulk has to several times as much, the fence stands in the lower part of
that leap; if they rise without one, it stands beyond the uppermost by a
multiple of the whole rise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import all_columns, give_back, once, staged

SYMBOLS = "#*$%&|<>"
WHITE_SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]

# Parameters: a fence is REACH spreads away, where a spread counts as at least SPREAD.
# A group of SMALL rows weighs as much as its language, a larger one more.
REACH, SMALL, SKETCH_K = 4.0, 200, 400
SPREAD = {"symbols": 0.04, "dup_lines": 0.1, "repeats": 0.1, "length": 1.5}
#: Ranks at which the sketches of ratios near 0 are read, and the leaps between two of them that part junk from the bulk:
#: by so much, and to LEAP times as much.  What is rarer than the last rank leaves does not make a leap.
RANKS = (*(r / 100 for r in range(50, 90, 2)), *(r / 100 for r in range(90, 99)))
LEAST_LEAP, LEAP, INTO = {"symbols": 0.1, "dup_lines": 0.3, "repeats": 0.3}, 3.0, 0.4
# Fixed value: quartile distances to the distance of the median from the 90 % quantile, of a normal distribution.
QUARTILES = 1.9


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one whole text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes are split at ASCII white space only
    word_chars = len(text) - sum(map(text.count, WHITE_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) < len(windows):
        covered = 0  # words before this index are counted already
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeats += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), len(lines), repeats


@once
@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS)
    give_back()


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def ratio_columns() -> dict:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("n_repeat_words") / words,
        "length": F.col("word_chars") / words,
    }


def first_leap(read: Column, k: str) -> Column:
    """low and high of the first leap between quantiles at RANKS; null if there is none."""
    steps = F.arrays_zip(F.slice(read, 1, len(RANKS) - 1).alias("low"), F.slice(read, 2, len(RANKS) - 1).alias("high"))
    return F.try_element_at(F.filter(steps, lambda s: (s["high"] - s["low"] >= LEAST_LEAP[k]) & (s["high"] >= LEAP * s["low"])), F.lit(1))


def beyond_bulk(read: Column, k: str) -> Column:
    """The fence of a ratio near 0, from its quantiles at RANKS: INTO of the way up
    the first leap, or beyond the last by REACH times the rise above the median."""
    leap, top = first_leap(read, k), F.element_at(read, -1)
    rise = F.greatest(top - F.element_at(read, 1), F.lit(SPREAD[k]))
    inside = leap["low"] + F.greatest(INTO * (leap["high"] - leap["low"]), F.lit(REACH * SPREAD[k]))
    return F.when(leap.isNull(), top + REACH * rise).otherwise(inside)


def fences(counts: DataFrame) -> DataFrame:
    """lang, source and an upper fence for each ratio (and a lower one for word length).

    ``counts`` needs lang, source and the counts.  Null languages and sources
    are groups of their own.  All rows that pass the base rules are sketched.
    Sketches of more than about SKETCH_K rows draw random bits, so that fences of
    large groups may differ from run to run in the third digit or below; a leap's
    ends are values of rows, and do not unless a rank falls on the leap itself.
    An empty table has no fences.
    """
    names = list(SPREAD)
    rows = counts.where(f"not {BASE_FAILED}").select("lang", "source", *[c.alias(k) for k, c in ratio_columns().items()])
    group = staged(
        rows.groupBy("lang", "source").agg(
            F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in names]
        ),
        "sketches",
    )
    per_lang = group.groupBy("lang").agg(
        F.sum("n").alias("lang_n"), *[F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(f"lang_{k}") for k in names]
    )
    joined = group.join(per_lang.withColumnRenamed("lang", "p_lang"), F.col("lang").eqNullSafe(F.col("p_lang")))

    own = F.col("n") / (F.col("n") + F.lit(SMALL))

    def weighted(fence, k: str):
        return own * fence(F.col(k), k) + (1 - own) * fence(F.col(f"lang_{k}"), k)

    quantile = F.kll_sketch_get_quantile_double

    def spread(sketch, k: str, lower: float, upper: float):
        return F.greatest(QUARTILES * (quantile(sketch, F.lit(upper)) - quantile(sketch, F.lit(lower))), F.lit(SPREAD[k]))

    # Each fence of the lengths takes its spread from the other side of the median, which
    # the rows beyond the fence do not reach while they are fewer than half.
    def upper(sketch, k: str):
        if k in LEAST_LEAP:
            return beyond_bulk(read(sketch), k)
        return quantile(sketch, F.lit(0.5)) + REACH * spread(sketch, k, 0.25, 0.5)

    def read(sketch):
        return F.array(*[quantile(sketch, F.lit(r)) for r in RANKS])

    def highest(k: str):
        """A group that leaps has no higher fence than its language, if its bulk lies below that."""
        if k not in LEAST_LEAP:
            return weighted(upper, k)
        leap = first_leap(read(F.col(k)), k)
        lower = F.least(upper(F.col(k), k), upper(F.col(f"lang_{k}"), k))
        return F.when(leap.isNull(), weighted(upper, k)).otherwise(F.greatest(leap["low"] + LEAST_LEAP[k] / 2, lower))

    def low(sketch, k: str):  # as many times below the median as the upper one is above it: positive
        mid = quantile(sketch, F.lit(0.5))
        return mid * mid / (mid + REACH * spread(sketch, k, 0.5, 0.75))

    return joined.select("lang", "source", *[highest(k).alias(f"max_{k}") for k in names], weighted(low, "length").alias("min_length"))


def with_verdict(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` and base_failed, kept.  A group without fences (none of its
    rows passed the base rules) has only rows that fail them."""
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in limits.columns if c not in ("lang", "source")])
    ratios = ratio_columns()
    good = (ratios["length"] >= F.col("_min_length"))
    for k, ratio in ratios.items():
        good = good & (ratio <= F.col(f"_max_{k}"))
    columns = counted.columns
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return (
        counted.join(limits, on, "left")
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False)))
        .select(*columns, "base_failed", "kept")
    )


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept for each row of ``docs``.

    Null and empty texts have counts of 0 and fail the base rules.  Repeated
    rows count each time and are judged alike.  Texts of any length are counted
    whole, an empty table gives no rows, other columns are ignored.
    """
    counted = staged(docs.select("doc_id", "lang", "source", counts_of("text").alias("c")).select("doc_id", "lang", "source", "c.*"), "counts")
    return with_verdict(counted, staged(fences(counted), "fences"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The counts are made twice, which costs less than writing whole texts.
    """
    counted = docs.select("lang", "source", counts_of("text").alias("c")).select("lang", "source", "c.*")
    limits = staged(fences(staged(counted, "counts")), "fences")
    rows = docs.select(F.struct(*all_columns(docs)).alias("row"), "lang", "source", counts_of("text").alias("c"))
    return with_verdict(rows.select("row", "lang", "source", "c.*"), limits).where("kept").select("row.*")
