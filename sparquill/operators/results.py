"""The whole answer to a request: one row for each page, from one reading of it.

Lines, links, tables, notes, metadata and audits of a page are parts of two
columns that ``articles.read_pages`` fills in one pass.  Everything here is an
expression over that row: no part is parsed again, nothing is joined or
shuffled, and Spark reads and computes only the parts that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.text import REPLACEMENT, replacements
from sparquill.operators import articles, audits, commands, notes

# Character references that stand for, or turn into, U+FFFD, and how many an audit names.
REFERENCE = "&#(?:[xX][0-9a-fA-F]+|[0-9]+);?"
SAMPLES = 40


def replaced_references(html: Column) -> Column:
    """reference and reason of the numeric references of a whole page that stand for
    U+FFFD or turn into it."""
    tokens = F.regexp_extract_all(html, F.lit(REFERENCE), F.lit(0))
    read = F.transform(tokens, lambda t: F.struct(F.substring(t, 1, 80).alias("reference"), replaced_reason(t).alias("reason")))
    return F.filter(read, lambda t: t["reason"].isNotNull())


def reference_audit(found: Column) -> Column:
    """Counts of ``replaced_references`` by reason, explicit ones and those that turn
    into U+FFFD, and the first SAMPLES."""
    number = lambda *reasons: F.size(F.filter(found, lambda t: t["reason"].isin(*reasons))).cast("long")
    return F.struct(
        number("explicit_replacement").alias("explicit"), number("null_character", "surrogate", "out_of_range").alias("invalid"),
        *[number(r).alias(r) for r in ("null_character", "surrogate", "out_of_range")],
        F.slice(found, 1, SAMPLES).alias("samples"), (F.size(found) > SAMPLES).alias("truncated"),
    )


def replaced_reason(token: Column) -> Column:
    """Why a numeric reference gives U+FFFD; null if it does not."""
    digits = F.ltrim(F.rtrim(F.substring(token, 3, 1 << 30), F.lit(";")), F.lit("0"))
    hexadecimal = F.ltrim(F.substring(digits, 2, 1 << 30), F.lit("0"))
    is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
    value = F.when(is_hex & (F.length(hexadecimal) <= 6), F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("long")).when(
        ~is_hex & (F.length(digits) <= 7), F.concat(F.lit("0"), digits).cast("long"))
    return (
        F.when(value.isNull() | (value > 0x10FFFF), "out_of_range").when(value == 0, "null_character")
        .when(value.between(0xD800, 0xDFFF), "surrogate").when(value == 0xFFFD, "explicit_replacement")
    )


def damaged_strings(article: Column, kind: T.StructType) -> Column:
    """path and text of the strings anywhere in the article's parts that hold replacement characters."""
    return F.filter(audits.strings_of(article, kind), lambda s: F.contains(s["text"], F.lit(REPLACEMENT)))


def structured_audit(found: Column) -> Column:
    """n replacement characters in n_values ``damaged_strings``, and the paths of the first."""
    return F.struct(
        F.aggregate(found, F.lit(0).cast("long"), lambda n, s: n + replacements(s["text"])).alias("n"), F.size(found).cast("long").alias("n_values"),
        F.slice(F.transform(found, lambda s: s["path"]), 1, SAMPLES).alias("paths"),
    )


def assemble(pages: DataFrame, key: str = "page_id", html: str = "html", section: str | None = None, find: str | None = None, context: int = 0,
             start: int = 1, count: int | None = 80, with_tables: bool = False, with_notes: bool = True, all_links: bool = False) -> DataFrame:
    """One row for each of ``pages`` (which ``articles.read_pages`` gave).

    key, status, candidates; page_title, article_state, closed, content; total_lines,
    returned_lines, lines (line, text), more_before, more_after, more_matches;
    headings; links (link_id, href, original_hrefs) and links_scope: all of the
    article where the whole of it is asked for, else those of the lines shown, of
    the tables and of the notes' entries; total_links; with tables: tables (table_idx,
    line, path) and their cells, of the section if one is asked for, and tables_scope;
    notes (see ``notes.of_page``), selected_notes, conflicts; last_updated,
    categories and tags; images; ads and chrome skipped; reference_audit,
    structured_audit, replacement_lines; warnings.

    A page that could not be read, or that lacks the section, keeps its row: its
    status says why, and its lines are empty.
    """
    page = commands.selected(pages, section, find, context, start, count)
    page = articles.with_metadata(page)
    a, s = F.col("article"), F.col("selection")
    ok = s["status"] == "ok"
    none = F.array().cast("array<bigint>")
    shown = F.when(ok, s["shown"]).otherwise(F.array().cast("array<int>"))
    refs = lambda name: F.flatten(F.transform(shown, lambda i: F.element_at(a["line_refs"], i)[name]))
    heading = F.element_at(a["headings"], 1)["text"] if section is None else F.element_at(F.filter(a["headings"], lambda h: h["line"] == s["first"]), 1)["text"]
    inside = a["tables"] if section is None else F.filter(a["tables"], lambda t: F.array_contains(t["path"], heading))
    tables = F.when(ok, inside).otherwise(F.slice(a["tables"], 1, 0))
    numbers = F.transform(tables, lambda t: t["table_idx"])
    cells = F.filter(a["cells"], lambda c: F.array_contains(numbers, c["table_idx"]))
    # what several parts of the answer use is worked out once
    page = page.withColumn("_refs", replaced_references(F.col(html))).withColumn("_damaged", damaged_strings(a, articles.ARTICLE))
    page = page.withColumn("_tables", tables).withColumn("_cells", cells).withColumn("_notes", notes.of_page(F.col("page.notes")))

    used = [refs("link_ids")]
    if with_tables:
        used.append(F.flatten(F.transform("_cells", lambda c: c["link_ids"])))
    if with_notes:  # an entry's links are those of the article with the same source
        hrefs = F.flatten(F.transform("_notes", lambda n: n["hrefs"]))
        used.append(F.transform(F.filter(a["links"], lambda x: F.arrays_overlap(x["original_hrefs"], hrefs)), lambda x: x["link_id"]))
    whole = all_links or (count is None and find is None and section is None)
    # links are numbered in the order in which they are listed
    links = a["links"] if whole else F.transform(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(u, none) for u in used]))), lambda i: F.element_at(a["links"], i.cast("int")))
    marked = F.transform(a["lines"], lambda x, i: F.when(F.contains(x, F.lit(REPLACEMENT)), i + 1))
    warned = [a["warnings"]]
    for condition, said in (
        (F.exists("_notes", lambda n: n["agreement"] == "conflict"), "footnotes disagree within this page; all versions are kept"),
        (F.exists("_notes", lambda n: n["definition_state"] == "missing"), "a footnote has no entry at the foot of the page"),
        (F.exists("_refs", lambda t: t["reason"] == "explicit_replacement"), "the page's source has references to U+FFFD"),
    ):
        warned.append(F.when(condition, F.array(F.lit(said))).otherwise(F.array().cast("array<string>")))
    tail = [
        F.col("_tables").alias("tables"), F.col("_cells").alias("cells"), F.lit("whole_article" if section is None else "selected_section").alias("tables_scope"),
    ] if with_tables else []
    noted = [
        F.col("_notes").alias("notes"), F.array_distinct(refs("notes")).alias("selected_notes"),
        F.transform(F.filter("_notes", lambda n: n["agreement"] == "conflict"), lambda n: n["number"]).alias("conflicts"),
    ] if with_notes else []
    skips = lambda kind: F.size(F.filter(a["skips"], lambda x: x["kind"] == kind)).cast("long")
    return page.select(
        key, s["status"].alias("status"), s["candidates"].alias("candidates"), a["page_title"].alias("page_title"),
        articles.article_state(a).alias("article_state"), a["closed"].alias("closed"), a["content"].alias("content"),
        F.size(a["lines"]).cast("long").alias("total_lines"), F.size(shown).cast("long").alias("returned_lines"),
        F.transform(shown, lambda i: F.struct(i.cast("long").alias("line"), F.element_at(a["lines"], i).alias("text"))).alias("lines"), *commands.more_flags(s),
        a["headings"].alias("headings"), links.alias("links"), F.lit("whole_article" if whole else "selected").alias("links_scope"), F.size(a["links"]).cast("long").alias("total_links"),
        *tail, *noted, "last_updated", "categories", "tags", a["images"].alias("images"), F.size(a["tables"]).cast("long").alias("total_tables"),
        skips("ad").alias("ads_skipped"), skips("chrome").alias("chrome_skipped"),
        reference_audit(F.col("_refs")).alias("reference_audit"), structured_audit(F.col("_damaged")).alias("structured_audit"),
        F.filter(marked, lambda i: i.isNotNull()).alias("replacement_lines"), F.concat(*warned).alias("warnings"),
    )


def rendered(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key and text: an assembled answer as plain text, in the order in which it is
    read: title and counts, state, metadata, lines, tables, notes, links, warnings."""
    join = lambda rows: F.array_join(rows, "\n")
    c = F.col

    def part(title: str, rows: Column) -> Column:
        return F.when(F.size(rows) > 0, F.concat(F.lit(f"{title}\n"), join(rows)))

    number = lambda n: n.cast("string")
    parts = [
        F.concat(F.lit("# "), F.coalesce("page_title", F.lit(""))),
        F.concat(F.lit("lines: "), number(c("total_lines")), F.lit("; returned: "), number(c("returned_lines")), F.lit("; more after: "), F.coalesce(number(c("more_after")), F.lit("false"))),
        F.when(c("status") != "ok", F.concat(F.lit("status: "), c("status"))),
        F.when(c("article_state") != "text", F.concat(F.lit("state: "), c("article_state"))),
        F.when(c("ads_skipped") + c("chrome_skipped") > 0, F.concat(F.lit("skipped: "), number(c("ads_skipped")), F.lit(" ads, "), number(c("chrome_skipped")), F.lit(" page furniture"))),
        F.concat(F.lit("updated: "), c("last_updated")), F.when(F.size("categories") > 0, F.concat(F.lit("categories: "), F.array_join("categories", ", "))),
        F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", "))),
        F.when(F.size("lines") > 0, join(F.transform("lines", lambda x: F.concat(number(x["line"]), F.lit(": "), x["text"])))),
    ]
    if "cells" in found.columns:
        parts.append(part("tables:", F.transform("cells", lambda x: F.concat(F.concat_ws(".", number(x["table_idx"]), number(x["row_idx"]), number(x["cell_idx"])), F.lit(": "), F.replace(x["text"], F.lit("\n"), F.lit(" / "))))))
    if "notes" in found.columns:
        asked = F.filter("notes", lambda n: F.array_contains("selected_notes", n["number"]))
        parts.append(part("footnotes:", F.transform(asked, lambda n: F.concat(F.lit("*"), number(n["number"]), F.lit(": "), F.coalesce(n["text"], F.lit(""))))))
        parts.append(F.when(F.size("conflicts") > 0, F.concat(F.lit("conflicting footnotes: "), F.array_join(c("conflicts").cast("array<string>"), ", "))))
    parts.append(part("links:", F.transform("links", lambda x: F.concat(F.lit("["), number(x["link_id"]), F.lit("] "), x["href"]))))
    parts.append(F.when(F.size("warnings") > 0, join(F.transform("warnings", lambda w: F.concat(F.lit("WARNING: "), w)))))
    return found.select(key, F.concat_ws("\n", *parts).alias("text"))
