"""Tables: spans spread over a logical grid, and records read from grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.pieces import by_pieces
from sparquill.functions.text import cell_value

# Limits beyond which a table has no grid.
MAX_ROWS, MAX_COLUMNS, MAX_AREA, MAX_SPAN, MAX_PAGE_AREA = 50_000, 256, 1_000_000, 10_000, 4_000_000


PLACED = T.StructType([
    T.StructField("warning", T.StringType()),
    T.StructField("cells", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("row", "col", "h", "w", "src_row", "src_cell")]))),
])


def place_cells(cells: list) -> tuple[str | None, list[tuple]]:
    """Why a table has no grid, or its cells as (row, column, height, width,
    source row, source cell); ``cells`` are (row, cell, rowspan, colspan) in
    order.  Cells go left to right into free columns."""
    height = max(c[0] for c in cells)
    if height > MAX_ROWS:
        return "rows", []
    taken: dict[int, set[int]] = {}
    placed, area, width, row, column = [], 0, 0, None, 1
    for source_row, cell, h, w in cells:
        if source_row != row:
            taken.pop(row, None)
            row, column = source_row, 1
        if h is None or w is None or not 1 <= h <= MAX_SPAN or not 1 <= w <= MAX_SPAN:
            return "span", []
        while column in taken.get(row, ()):
            column += 1
        area += h * w
        width = max(width, column + w - 1)
        if width > MAX_COLUMNS or area > MAX_AREA or height * width > MAX_AREA:
            return "size", []
        if row + h - 1 > height:
            return "rowspan past the last row", []
        span = range(column, column + w)
        for r in range(row, row + h):
            if not taken.setdefault(r, set()).isdisjoint(span):
                return "overlap", []
            taken[r].update(span)
        placed.append((row, column, h, w, row, cell))
        column += w
    return None, placed


@by_pieces(PLACED)
def place(tables: pd.Series) -> pd.DataFrame:
    rows = [place_cells([(c["row_idx"], c["cell_idx"], c["rowspan"], c["colspan"]) for c in cells]) for cells in tables]
    names = PLACED["cells"].dataType.elementType.fieldNames()
    return pd.DataFrame({"warning": [w for w, _ in rows], "cells": [[dict(zip(names, c, strict=True)) for c in cells] for _, cells in rows]})


def expand(cells: DataFrame, key: str = "page_id", most: int = MAX_PAGE_AREA) -> DataFrame:
    """key, table_idx, grid_row, grid_col, src_row, src_cell, warning.

    ``cells``: key, table_idx, row_idx, cell_idx, rowspan, colspan.  A table
    without a grid gives one row with a warning and null coordinates, as do those
    with which a page's grids come to more than ``most`` positions.  Only the
    placing, where each cell depends on those before it, leaves the JVM, for
    many tables at once; the spans are spread by ``sequence``.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("row_idx", "cell_idx", "rowspan", "colspan")])))
    tables = cells.groupBy(key, "table_idx").agg(ordered.alias("cells")).select(key, "table_idx", place.asNondeterministic()("cells").alias("placed"))
    area = F.aggregate("placed.cells", F.lit(0).cast("long"), lambda s, c: s + c["h"] * c["w"])
    so_far = F.sum(area).over(Window.partitionBy(key).orderBy("table_idx").rowsBetween(Window.unboundedPreceding, 0))
    over = so_far > most
    tables = tables.select(
        key, "table_idx", F.when(over, "page size").otherwise(F.col("placed.warning")).alias("warning"), F.when(~over, F.col("placed.cells")).alias("cells")
    )
    return spread(tables.select(key, "table_idx", "warning", F.inline_outer("cells")), key)


def spread(placed: DataFrame, key: str) -> DataFrame:
    """Every grid position of placed cells."""
    rows = F.explode_outer(F.when(F.col("row").isNotNull(), F.sequence("row", F.col("row") + F.col("h") - 1)))
    columns = F.explode_outer(F.when(F.col("col").isNotNull(), F.sequence("col", F.col("col") + F.col("w") - 1)))
    return (
        placed.withColumn("grid_row", rows).withColumn("grid_col", columns)
        .select(key, "table_idx", "grid_row", "grid_col", "src_row", "src_cell", "warning")
    )


def naming_records(grid: DataFrame, labels: tuple[str, str, str], key: str = "table_idx") -> DataFrame:
    """key, grid_row, counterpart, calls, called_by.

    ``grid``: key, grid_row, grid_col, text, src (identity of the source cell).
    A row that holds all three labels sets the columns for the rows below, until
    the next such row; rows whose three cells are one source cell, or whose
    counterpart is empty or a label, are left out.
    """
    bare = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"(?U)\s+", "")
    at = [F.min(F.when(bare == label, F.col("grid_col"))).alias(f"c{i}") for i, label in enumerate(labels)]
    rows = grid.groupBy(key, "grid_row").agg(
        *at, F.map_from_entries(F.collect_list(F.struct("grid_col", F.struct(F.coalesce("text", F.lit("")).alias("text"), "src")))).alias("cells")
    )
    header = F.when(F.col("c0").isNotNull() & F.col("c1").isNotNull() & F.col("c2").isNotNull(), F.struct("c0", "c1", "c2"))
    above = Window.partitionBy(key).orderBy("grid_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    data = rows.withColumn("own", header).withColumn("header", F.last("own", ignorenulls=True).over(above)).where("own is null and header is not null")
    cells = [F.try_element_at("cells", F.col(f"header.c{i}")) for i in range(3)]
    value = lambda c, sep: F.array_join(F.filter(F.transform(F.split(c["text"], "\n"), cell_value), lambda v: v != ""), sep)
    out = data.select(
        key, "grid_row", value(cells[0], " ").alias("counterpart"), value(cells[1], "、").alias("calls"), value(cells[2], "、").alias("called_by"),
        F.size(F.array_distinct(F.array(*[c["src"] for c in cells]))).alias("sources"),
    )
    return out.where(F.col("counterpart").isNotNull() & (F.col("sources") == 3) & (F.col("counterpart") != "") & ~F.col("counterpart").isin(*labels)).drop("sources")


def definition_items(rows: DataFrame, key: str) -> DataFrame:
    """key, label and its values in order, joined; ``rows``: key, ord, kind (dt or
    dd), text.  Values belong to the last label above them."""
    above = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = rows.withColumn("group_no", F.sum((F.col("kind") == "dt").cast("int")).over(above)).withColumn(
        "label", F.last(F.when(F.col("kind") == "dt", F.col("text")), ignorenulls=True).over(above)
    )
    return group.where("kind = 'dd' and label is not null").groupBy(key, "group_no", "label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "、").alias("items")
    ).drop("group_no")
