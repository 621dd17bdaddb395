"""Lookups over a corpus: roster, profiles, pages, full-text search, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions.text import REPLACEMENT


def roster(people: DataFrame, region: str | None = None, generation: str | None = None, category: str | None = None) -> DataFrame:
    """People of a region, generation or category, in order of slug."""
    for column, wanted in (("region", region), ("generation", generation), ("category", category)):
        if wanted is not None:
            people = people.where(F.col(column) == wanted)
    return people.orderBy("slug")


def page_list(pages: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Pages with their number of lines, 0 for those without."""
    n = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))
    return pages.join(n, key, "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def search(lines: DataFrame, literal: str, limit: int, key: str, width: int = 300) -> DataFrame:
    """The first ``limit`` lines of the corpus with a literal, long ones cut."""
    if not literal.strip() or limit < 1:
        raise ValueError("a search needs a literal and a limit of at least 1")
    cut = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("…"))).otherwise(F.col("text"))
    return lines.where(F.contains("text", F.lit(literal))).orderBy(key, "line").limit(limit).select(key, "line", cut.alias("text"))


def used_links(links: DataFrame, used: list[DataFrame], key: str) -> DataFrame:
    """Links whose id is used by any of the given tables (key, link_id)."""
    ids = used[0].select(key, "link_id")
    for more in used[1:]:
        ids = ids.unionByName(more.select(key, "link_id"))
    return links.join(ids.distinct(), [key, "link_id"], "left_semi")


def tables_below(tables: DataFrame, heading: str) -> DataFrame:
    """Tables (with ``path``, the headings above them) inside a section."""
    return tables.where(F.array_contains("path", heading))


def near_headings(tables: DataFrame, heading: str, key: str, most: int = 20) -> DataFrame:
    """key and candidates: for pages without a table below ``heading``, the headings
    above their tables that hold it."""
    paths = tables.select(key, F.explode_outer("path").alias("heading"))
    near = F.when(F.contains("heading", F.lit(heading)), F.col("heading"))
    found = paths.groupBy(key).agg(F.max(F.coalesce(F.col("heading") == heading, F.lit(False))).alias("exact"), F.sort_array(F.collect_set(near)).alias("candidates"))
    return found.where(~F.col("exact")).select(key, F.slice("candidates", 1, most).alias("candidates"))


def visible_lines(positions: DataFrame, key: str) -> DataFrame:
    """line of every position: its own if it is visible, else the one before, else
    the next, else 1.  ``positions``: key, pos, line (null where blank)."""
    so_far = lambda order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("line", ignorenulls=True).over(so_far(F.asc("pos")))
    after = F.last("line", ignorenulls=True).over(so_far(F.desc("pos")))
    return positions.select(key, "pos", F.coalesce(before, after, F.lit(1)).cast("long").alias("line"))


def grid_size(grid: DataFrame, key: str) -> DataFrame:
    """key, table_idx, height, width and holes of each grid."""
    filled = F.count_distinct("grid_row", "grid_col")
    return grid.where("grid_row is not null").groupBy(key, "table_idx").agg(
        F.max("grid_row").alias("height"), F.max("grid_col").alias("width"), (F.max("grid_row") * F.max("grid_col") - filled).alias("holes")
    )


def filled_grid(grid: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Grid positions with their source cell's text."""
    source = cells.select(key, "table_idx", F.col("row_idx").alias("src_row"), F.col("cell_idx").alias("src_cell"), "text")
    return grid.join(source, [key, "table_idx", "src_row", "src_cell"], "left")


def damaged_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field (a JSON pointer) and n: replacement characters by field."""
    parts = [F.struct(F.lit("/" + f.replace("~", "~0").replace("/", "~1")).alias("field"), F.col(f).cast("string").alias("v")) for f in fields]
    found = rows.select(key, F.inline(F.array(*parts))).where(F.contains("v", F.lit(REPLACEMENT)))
    n: Column = F.length("v") - F.length(F.replace("v", F.lit(REPLACEMENT), F.lit("")))
    return found.select(key, "field", n.cast("long").alias("n"))


def inventory(elements: DataFrame, zone: str = "zone", kind: str = "kind", kinds: tuple[str, ...] = ("ad", "chrome")) -> DataFrame:
    """Elements of each kind by zone."""
    return elements.groupBy(zone).pivot(kind, list(kinds)).count().na.fill(0)


def profiles_of(resolved: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles of the names that resolved to one entity, and how they matched."""
    found = resolved.where("status = 'ok'").select("qid", "query", "stage", F.element_at("slugs", 1).alias("slug"))
    return found.join(profiles, "slug")
