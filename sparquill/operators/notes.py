"""Footnotes: markers in the text held against entries at the page's foot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions.text import collapse
from sparquill.operators import markup


def judged(titles: Column, texts: Column, referenced: Column, defined: Column, without_text: Column) -> list[Column]:
    """agreement, reference_state and definition_state of a note, from the distinct
    texts of its markers and of its entries, whether it has any of these, and
    whether an entry holds something other than text."""
    agreement = (
        F.when(F.size(F.array_union(titles, texts)) > 1, "conflict")
        .when((F.size(titles) > 0) & (F.size(texts) > 0), "match")
        .when(F.size(titles) > 0, "marker_only")
        .when(F.size(texts) > 0, "footer_only")
        .otherwise("unavailable")
    )
    definition = F.when(~defined, "missing").when(F.size(texts) > 0, "text").when(without_text, "non_text").otherwise("empty")
    return [agreement.alias("agreement"), F.when(referenced, "referenced").otherwise("unreferenced").alias("reference_state"), definition.alias("definition_state")]


def reconcile(markers: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """key, number, text, agreement, reference_state and definition_state.

    ``markers``: key, number, title; ``entries``: key, number, text (null for an
    entry with no text but links or media), ord.  Texts compare with white space folded.
    """
    said = markers.groupBy(key, "number").agg(
        F.collect_set(F.nullif(F.trim(collapse(F.col("title"))), F.lit(""))).alias("titles"),
        F.min_by("title", F.struct("title")).alias("title"),
    )
    defined = entries.groupBy(key, "number").agg(
        F.collect_set(F.nullif(F.trim(collapse(F.col("text"))), F.lit(""))).alias("texts"),
        F.min_by("text", "ord").alias("entry"),
        F.max(F.col("text").isNull()).alias("without_text"),
    )
    both = said.join(defined, [key, "number"], "full_outer")
    none = F.array().cast("array<string>")
    titles, texts = F.coalesce("titles", none), F.coalesce("texts", none)
    return both.select(
        key, "number", F.coalesce(F.nullif("entry", F.lit("")), "title").alias("text"),
        *judged(titles, texts, F.col("titles").isNotNull(), F.col("texts").isNotNull(), F.coalesce("without_text", F.lit(False))),
    )


# --- notes in a page's markup --------------------------------------------------

def markers(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, number, title, ord, line: links to notes, with what their title says."""
    return markup.read(pages, key, html).select(key, F.inline("page.markers"))


def entries(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, number, text, ord, hrefs: rows of the note lists (see ``markup.note_entries``)."""
    return markup.read(pages, key, html).select(key, F.inline("page.entries"))


def of_page(notes: Column) -> Column:
    """number, text, agreement, reference_state, definition_state and hrefs of each
    note of a page that ``markup`` has read: ``reconcile`` within the row."""
    return F.transform(notes, lambda n: F.struct(
        n["number"].alias("number"), F.coalesce(F.nullif(n["entry"], F.lit("")), n["title"]).alias("text"),
        *judged(n["titles"], n["texts"], n["marks"] > 0, n["rows"] > 0, n["without_text"] > 0), n["hrefs"].alias("hrefs")))


def diagnose(found: DataFrame, key: str) -> DataFrame:
    """key and the numbers of notes that are missing, empty, unreferenced or not text."""
    having = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("number"))))
    state, reference = F.col("definition_state"), F.col("reference_state")
    return found.groupBy(key).agg(
        having(state == "missing").alias("missing"), having(state == "empty").alias("empty"),
        having(reference == "unreferenced").alias("unreferenced"), having(state == "non_text").alias("non_text"),
    )
