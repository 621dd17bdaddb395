"""Data quality: character references, replacement characters, byte units, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.charset import odd_units, unit_category
from sparquill.functions.text import REPLACEMENT, replacements
from sparquill.functions.urls import escape_pointer


def references(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, token, reason and n of the character references of each page."""
    found = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit("&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z]+);"), 1)).alias("token"))
    return found.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", reference_kind(F.col("token")))


def reference_kind(token: Column) -> Column:
    """named, or what a numeric reference stands for."""
    value = _number(token)
    return (
        F.when(~F.startswith(token, F.lit("#")), "named")
        .when(value.isNull() | (value > 0x10FFFF), "out_of_range")
        .when(value == 0, "null_character")
        .when(value.between(0xD800, 0xDFFF), "surrogate")
        .when(value.between(0x80, 0x9F), "c1_control")
        .otherwise("character")
    )


def _number(token: Column) -> Column:
    hexadecimal = F.regexp_extract(token, "^#[xX]0*([0-9a-fA-F]{0,8})$", 1)
    decimal = F.regexp_extract(token, "^#0*([0-9]{0,9})$", 1)
    return F.when(token.rlike("^#[xX]0*[0-9a-fA-F]{0,8}$"), F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10)).when(
        token.rlike("^#0*[0-9]{0,9}$"), F.concat(F.lit("0"), decimal)
    ).cast("long")


def reference_report(found: DataFrame, key: str = "page_id", samples: int = 40) -> DataFrame:
    """key, reason, n and samples: of each reason its tokens, the most frequent first."""
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy(key, "reason").orderBy(F.desc("n"), "token")))
    return ranked.groupBy(key, "reason").agg(
        F.sum("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.struct("place", "token")))), lambda s: s["token"]).alias("samples"),
    )


def replaced(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and n of the rows that hold replacement characters."""
    return texts.select(key, replacements(F.col(text)).alias("n")).where("n > 0")


def byte_units(texts: DataFrame, text: str = "text", most: int = 40) -> DataFrame:
    """unit (UTF-8 bytes in hex) and n of the most frequent characters beyond
    ASCII; ties by unit.

    Characters are counted inside each text first, so the shuffle carries one
    row for each distinct character of a partition.
    """
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7f]"), 0)).alias("c"))
    counted = found.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.hex(F.encode("c", "UTF-8")).alias("unit"), "n").orderBy(F.desc("n"), "unit").limit(most)


def extension_units(bodies: DataFrame, key: str, raw: str = "raw", places: int = 5, most: int = 40) -> DataFrame:
    """key, unit (hex), category, n, offsets and lines of what the default
    character set lacks, and n_units of the page.

    The first ``places`` offsets are listed, and the ``most`` frequent units of a
    page; n and n_units count all."""
    found = bodies.select(key, F.inline(odd_units(raw))).withColumn("unit", F.lower(F.hex("unit")))
    first = found.withColumn("place", F.row_number().over(Window.partitionBy(key, "unit").orderBy("offset")))
    at = F.array_sort(F.collect_list(F.when(F.col("place") <= places, F.struct("offset", "line"))))
    counted = first.groupBy(key, "unit").agg(F.count(F.lit(1)).alias("n"), at.alias("at"))
    kinds = counted.select("unit").distinct().select("unit", unit_category(F.unhex("unit")).alias("category"))
    page = Window.partitionBy(key)
    ranked = counted.join(kinds, "unit").withColumn("n_units", F.count(F.lit(1)).over(page)).withColumn("rank", F.row_number().over(page.orderBy(F.desc("n"), "unit")))
    return ranked.where(F.col("rank") <= most).select(
        key, "unit", "category", "n", F.transform("at", lambda a: a["offset"]).alias("offsets"), F.transform("at", lambda a: a["line"]).alias("lines"), "n_units")


def extension_categories(bodies: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, category, occurrences and distinct_units over all units of a page."""
    found = bodies.select(key, F.inline(odd_units(raw))).groupBy(key, "unit").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy(key, unit_category("unit").alias("category")).agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("distinct_units"))


def strings_of(column: Column, kind: T.DataType, path: Column | None = None) -> Column:
    """An array of path (a JSON pointer) and text: every string in a nested column.

    The walk follows the declared type, so it is one expression of the plan,
    whatever the depth; list places count from 0."""
    path = F.lit("") if path is None else path
    none = F.array().cast("array<struct<path:string,text:string>>")
    step = lambda name: F.concat(path, F.lit("/"), name)
    if isinstance(kind, T.StringType):
        found = F.array(F.struct(path.alias("path"), column.alias("text")))
    elif isinstance(kind, T.StructType):
        parts = [strings_of(column[f.name], f.dataType, step(F.lit(f.name.replace("~", "~0").replace("/", "~1")))) for f in kind]
        found = F.concat(*parts) if parts else none
    elif isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(column, lambda x, i: strings_of(x, kind.elementType, step(i.cast("string")))))
    elif isinstance(kind, T.MapType):
        found = F.flatten(F.transform(F.map_entries(column), lambda e: strings_of(e["value"], kind.valueType, step(escape_pointer(e["key"].cast("string"))))))
    else:
        found = none
    return F.filter(F.coalesce(found, none), lambda s: s["text"].isNotNull())


def damaged_strings(rows: DataFrame, key: str, fields: list[str], samples: int = 40, before: int = 40, after: int = 160) -> DataFrame:
    """key, path, n, excerpt, n_values and truncated: strings with replacement
    characters anywhere in nested fields.

    The first ``samples`` by path of each row are listed with the text around the
    first damage; n_values counts all."""
    arrays = [strings_of(F.col(f), rows.schema[f].dataType, F.lit("/" + f.replace("~", "~0").replace("/", "~1"))) for f in fields]
    found = rows.select(key, F.inline(F.filter(F.concat(*arrays), lambda s: F.contains(s["text"], F.lit(REPLACEMENT)))))
    at = F.instr("text", REPLACEMENT)
    start = F.greatest(at - before, F.lit(1))
    whole = Window.partitionBy(key)
    ranked = found.withColumn("place", F.row_number().over(whole.orderBy("path"))).withColumn("n_values", F.count(F.lit(1)).over(whole))
    return ranked.where(F.col("place") <= samples).select(
        key, "path", replacements(F.col("text")).alias("n"), F.substring("text", start, at - start + after).alias("excerpt"), "n_values",
        (F.col("n_values") > samples).alias("truncated"))


def counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def bounded(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group, and whether the group has more."""
    w = Window.partitionBy(*group)
    numbered = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= most + 1)
    return numbered.withColumn("truncated", F.max("place").over(w) > most).where(F.col("place") <= most).drop("place")
