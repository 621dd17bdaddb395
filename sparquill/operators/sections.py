"""Headings: where sections end, which lines they hold, the path above a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounds(headings: DataFrame, key: str, totals: DataFrame | None = None) -> DataFrame:
    """key, level, text, line and end_line: the line before the next heading of
    the same or a higher level, else the last line (``totals``: key, total; or the
    headings' own column total, which saves a join).

    Headings of one document are gone through from the last to the first, with
    the line of the next one of each level kept as a running minimum.
    """
    levels = range(1, 7)
    after = Window.partitionBy(key).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.min(F.when(F.col("level") <= n, F.col("line"))).over(after) for n in levels]
    end = F.element_at(F.array(*nexts), F.col("level").cast("int")) - 1
    rows = headings if totals is None else headings.join(totals, key)
    return rows.select(key, "level", "text", "line", F.coalesce(end, F.col("total")).cast("long").alias("end_line"))


def choose(found: DataFrame, key: str, wanted: str) -> DataFrame:
    """For each document the section whose heading is ``wanted``, or else holds
    it: key, status (ok, section_not_found, ambiguous_section), candidates (20 at
    most), line and end_line where it is the only one."""
    exact = F.col("text") == wanted
    rank = F.when(exact, 1).when(F.contains("text", F.lit(wanted)), 2)
    ranked = found.withColumn("rank", rank)
    best = F.min("rank").over(Window.partitionBy(key))
    hits = ranked.withColumn("hit", F.coalesce(F.col("rank") == best, F.lit(False)))
    n = F.count_if("hit")
    return hits.groupBy(key).agg(
        F.when(n == 0, "section_not_found").when(n > 1, "ambiguous_section").otherwise("ok").alias("status"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("line", "text")))), lambda s: s["text"]), 1, 20).alias("candidates"),
        F.when(n == 1, F.min(F.when(F.col("hit"), F.col("line")))).alias("line"),
        F.when(n == 1, F.min(F.when(F.col("hit"), F.col("end_line")))).alias("end_line"),
    )


def section_lines(lines: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Lines inside the chosen sections (key, line, end_line)."""
    ranges = chosen.select(key, F.col("line").alias("_from"), F.col("end_line").alias("_to"))
    return lines.join(ranges, key).where(F.col("line").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def heading_paths(headings: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """key, place and path: the headings in force at each place (key, place)."""
    both = headings.select(key, F.col("line").alias("at"), "level", "text", F.lit(None).cast("long").alias("place")).unionByName(
        places.select(key, F.col("place").alias("at"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), "place")
    )
    return paths(both, key)


def paths(both: DataFrame, key: str) -> DataFrame:
    """key, place and path of ``both``: key, at, level and text of headings, and key, at
    and place of places.

    One pass over headings and places in page order: the last heading of each
    level counts if no heading of a higher level came after it.
    """
    so_far = Window.partitionBy(key).orderBy("at", F.col("place").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.col("level")
    for n in range(1, 7):
        both = both.withColumn(f"h{n}", F.last(F.when(level == n, F.struct("at", "text")), ignorenulls=True).over(so_far))
    for n in range(2, 7):
        newest = F.max(F.when(level < n, F.col("at"))).over(so_far)
        both = both.withColumn(f"h{n}", F.when(F.coalesce(newest, F.lit(0)) < F.col(f"h{n}.at"), F.col(f"h{n}")))
    path = F.filter(F.array(*[F.col(f"h{n}.text") for n in range(1, 7)]), lambda x: x.isNotNull())
    return both.where("place is not null").select(key, "place", path.alias("path"))
