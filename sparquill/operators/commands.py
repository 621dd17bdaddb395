"""Whole requests, composed of the other operators: read, show, story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators import lines as line_ops
from sparquill.operators import packs

# Fixed value: candidates that an answer without a single section names.
CANDIDATES = 20


def section_of(headings: Column, total: Column, wanted: str) -> Column:
    """status, candidates, first and last line of the section ``wanted`` among a
    page's headings: those that are equal to it count before those that hold it."""
    exact = F.filter(headings, lambda h: h["text"] == wanted)
    some = F.filter(headings, lambda h: F.contains(h["text"], F.lit(wanted)))
    hits = F.when(F.size(exact) > 0, exact).otherwise(some)
    own = F.try_element_at(hits, F.lit(1))
    later = F.filter(headings, lambda h: (h["line"] > own["line"]) & (h["level"] <= own["level"]))
    end = F.coalesce(F.array_min(F.transform(later, lambda h: h["line"])) - 1, total)
    status = F.when(F.size(hits) == 0, "section_not_found").when(F.size(hits) > 1, "ambiguous_section").otherwise("ok")
    one = F.size(hits) == 1
    return F.struct(
        status.alias("status"), F.slice(F.transform(hits, lambda h: h["text"]), 1, CANDIDATES).alias("candidates"),
        F.when(one, own["line"]).cast("int").alias("first"), F.when(one, end).cast("int").alias("last"),
    )


def selected(articles: DataFrame, section: str | None = None, find: str | None = None, context: int = 0, start: int = 1, count: int | None = 80) -> DataFrame:
    """``articles`` and selection: status, candidates, first and last line of what is
    asked of a page (see ``read``), near (the lines that pages are cut from), begin
    (the first of them that is shown), shown and hits.  A page is one row, so
    nothing is shuffled."""
    if find is not None and not find.strip():
        raise ValueError("the literal to find is blank")
    none, total = F.array().cast("array<int>"), F.size("article.lines")
    whole = F.struct(F.lit("ok").alias("status"), F.array().cast("array<string>").alias("candidates"), F.lit(1).alias("first"), total.alias("last"))
    chosen = whole if section is None else section_of(F.col("article.headings"), total, section)
    failed = F.col("article.error_code").isNotNull()
    page = articles.withColumn("_chosen", chosen)
    first, last = (F.when(~failed, F.col(f"_chosen.{c}")) for c in ("first", "last"))
    page = page.withColumn("_first", first).withColumn("_last", last)
    page = page.withColumn("_inside", F.when(F.col("_last") >= F.col("_first"), F.sequence("_first", "_last")).otherwise(none))
    if find is None:
        page = page.withColumn("_hits", none).withColumn("_near", F.col("_inside")).withColumn("_begin", F.lit(1 if count is None else start))
        shown = F.col("_near") if count is None else F.slice("_near", start, count)
    else:
        page = page.withColumn("_hits", F.filter("_inside", lambda i: F.contains(F.element_at("article.lines", i), F.lit(find))))
        frames = F.transform("_hits", lambda h: F.sequence(F.greatest(h - context, F.col("_first")), F.least(h + context, F.col("_last"))))
        page = page.withColumn("_near", F.array_distinct(F.flatten(frames)))
        if count is None:
            begin, size = F.lit(1), F.size("_near")
        else:
            at = F.try_element_at("_hits", F.lit(start))
            floor = F.greatest(at - context, (F.coalesce(F.try_element_at("_hits", F.lit(start - 1)), F.lit(0)) if start > 1 else F.lit(0)) + 1)
            begin = F.greatest(F.size(F.filter("_near", lambda i: i < floor)) + 1, F.array_position("_near", at).cast("int") - count + 1)
            begin, size = F.coalesce(begin, F.lit(1)), F.when(at.isNotNull(), count).otherwise(0)
        page = page.withColumn("_begin", begin)
        shown = F.slice("_near", F.col("_begin"), size)
    page = page.withColumn("_shown", shown)
    return page.withColumn("selection", F.struct(
        F.when(failed, F.col("article.error_code")).otherwise(F.col("_chosen.status")).alias("status"), F.col("_chosen.candidates").alias("candidates"),
        *[F.col(f"_{c}").alias(c) for c in ("first", "last", "near", "begin", "shown", "hits")],
    )).drop("_chosen", "_first", "_last", "_inside", "_hits", "_near", "_begin", "_shown")


def more_flags(s: Column) -> list[Column]:
    """more_before, more_after and more_matches of a selection."""
    flag = lambda c, name: F.when(s["status"] == "ok", F.coalesce(c, F.lit(False))).alias(name)
    return [
        flag((s["begin"] > 1) & (F.size(s["near"]) > 0), "more_before"), flag(s["begin"] + F.size(s["shown"]) - 1 < F.size(s["near"]), "more_after"),
        flag(F.array_max(s["hits"]) > F.array_max(s["shown"]), "more_matches"),
    ]


def read(articles: DataFrame, key: str = "page_id", section: str | None = None, find: str | None = None, context: int = 0,
         start: int = 1, count: int | None = 80) -> DataFrame:
    """key, status, candidates, line, text, link_ids, notes, more_before, more_after
    and more_matches: what is asked of each parsed page (see ``articles.ARTICLE``).

    Of the whole article or one section, ``count`` lines (None: all) from number
    ``start`` on, or, with ``find``, lines within ``context`` of a match from match
    ``start`` on.  A page whose section is missing or not single, or that could
    not be parsed, is one row with its status and no line; pages without a match
    give none.
    """
    page = selected(articles.select(key, "article"), section, find, context, start, count)
    s = F.col("selection")
    of_line = lambda name: lambda i: F.element_at("article.line_refs", i)[name].alias(name)
    rows = line_ops._rows(F.col("selection.shown"), "article.lines", of_line("link_ids"), of_line("notes"))
    none = F.lit(None)
    missing = F.array(F.struct(none.cast("long").alias("line"), none.cast("string").alias("text"), none.cast("array<bigint>").alias("link_ids"), none.cast("array<bigint>").alias("notes")))
    return page.select(
        key, s["status"].alias("status"), s["candidates"].alias("candidates"), *more_flags(s), F.inline(F.when(s["status"] == "ok", rows).otherwise(missing)),
    ).select(key, "status", "candidates", "line", "text", "link_ids", "notes", "more_before", "more_after", "more_matches")


def rendered(found: DataFrame, key: str = "page_id", mark: str = ": ") -> DataFrame:
    """key, status and text: what ``read`` gives, as numbered lines, one text a page."""
    line = F.concat(F.col("line").cast("string"), F.lit(mark), F.col("text"))
    rows = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", line.alias("shown")))))
    return found.groupBy(key, "status").agg(F.array_join(F.transform(rows, lambda r: r["shown"]), "\n").alias("text"))


def show(resolved: DataFrame, cards: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """qid, query, slug, section, status, line and text: the cards of the names
    that mean one entity (see ``naming.resolve``), whole or the wanted sections.

    ``cards``: slug and article.  Names that mean none or several stay as rows
    with their status."""
    asked = resolved.select("qid", "query", F.col("status").alias("name_status"), F.when(F.col("status") == "ok", F.element_at("slugs", 1)).alias("slug"))
    parts = [read(cards, "slug", section=w, count=None).select("slug", F.lit(w).cast("string").alias("section"), "status", "line", "text") for w in wanted or [None]]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return asked.join(found, "slug", "left").select(
        "qid", "query", "slug", "section", F.when(F.col("name_status") != "ok", F.col("name_status")).otherwise(F.coalesce("status", F.lit("no_card"))).alias("status"), "line", "text")


def story(cast: DataFrame, items: DataFrame, pairs: DataFrame, tiers=packs.TIERS) -> DataFrame:
    """pack, tier, place, kind, name, other and text: the fullest pack of each cast
    that its budget allows.

    ``cast``: pack, name, place and limit (null: the automatic budget); ``items``:
    name, detail, text; ``pairs``: src, dst, detail, text, for pairs of members in
    either direction.  Each tier says which detail items and pairs are given in;
    ``packs.first_fitting_tier`` takes the first whose texts fit, tier 99 if none
    does, which gives the smallest.  Items come in the order of the cast, then pairs.
    """
    members = cast.select("pack", "name", "place")
    limits = cast.groupBy("pack").agg(F.coalesce(F.max("limit"), packs.automatic_budget(F.count(F.lit(1)))).alias("limit"))
    own = members.join(items, "name").select("pack", "detail", F.lit("item").alias("kind"), "place", F.lit(0).cast("long").alias("place_2"), "name", F.lit(None).cast("string").alias("other"), "text")
    a = members.select("pack", F.col("name").alias("src"), F.col("place").alias("p"))
    b = members.select("pack", F.col("name").alias("dst"), F.col("place").alias("q"))
    both = pairs.join(a, "src").join(b, ["pack", "dst"]).select("pack", "detail", F.lit("pair").alias("kind"), F.col("p").alias("place"), F.col("q").cast("long").alias("place_2"),
                                                               F.col("src").alias("name"), F.col("dst").alias("other"), "text")
    texts = own.unionByName(both)
    ranked = F.explode(F.array(*[F.struct(F.lit(n).alias("rank"), F.lit(k).alias("kind"), F.lit(d).alias("detail"))
                                 for n, (i, p) in enumerate(tiers, 1) for k, d in (("item", i), ("pair", p))])).alias("t")
    wanted = cast.sparkSession.range(1).select(ranked).select("t.*")
    sized = texts.groupBy("pack", "kind", "detail").agg(F.sum(F.length("text")).alias("size"))
    by_tier = sized.join(wanted, ["kind", "detail"]).groupBy("pack", "rank").agg(F.sum("size").alias("size")).join(limits, "pack")
    chosen = packs.first_fitting_tier(by_tier, "pack")
    least = by_tier.groupBy("pack").agg(F.min_by("rank", F.struct("size", "rank")).alias("least"))
    taken = chosen.join(least, "pack").withColumn("rank", F.when(F.col("tier") == 99, F.col("least")).otherwise(F.col("tier")))
    kept = texts.join(taken.select("pack", "tier", "rank").join(wanted, "rank"), ["pack", "kind", "detail"])
    order = Window.partitionBy("pack").orderBy("kind", "place", "place_2")
    return kept.select("pack", "tier", F.row_number().over(order).cast("long").alias("place"), "kind", "name", "other", "text")
