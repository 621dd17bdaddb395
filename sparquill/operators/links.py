"""Links of pages, the title index, and searches in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import urls
from sparquill.functions.text import REPLACEMENT, closeness
from sparquill.operators import markup

# Fixed value: longest URL that a title index learns.
LONGEST_URL = 1024


# What holds no links; an anchor's attributes; the value of its address.
SILENT = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
RAW = r"(?i)<(?:!--|(?:script|style|textarea|xmp|iframe|noembed|noframes|plaintext)\b)|<title[^<>]*>[^<]*<a"
QUOTED = r"""="[^"]*"|='[^']*'"""
ANCHOR, ANCHOR_START = r"(?i)<a(\s[^<>]*)>", r"(?i)<a[\s/]"
ADDRESS = r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)"""


def hrefs_of(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and hrefs: the addresses of a page's anchors, in order.

    Plain anchors are read by Spark's own functions.  Pages with one that these
    may misread (brackets or references in it, href twice or without a value,
    elements whose text is not markup) go through the parser."""
    clean = pages.select(key, html, F.regexp_replace(html, SILENT, " ").alias("_clean"))
    tags = clean.select(key, html, "_clean", F.regexp_extract_all("_clean", F.lit(ANCHOR), 1).alias("_tags"))
    words = lambda t: F.regexp_count(t, F.lit("(?i)href"))
    unclear = lambda t: F.contains(t, F.lit("&")) | F.regexp_replace(t, QUOTED, "").rlike("[\"']") | (words(t) > F.least(F.regexp_count(t, F.lit(ADDRESS)), F.lit(1)))
    odd = F.col("_clean").rlike(RAW) | (F.size("_tags") != F.regexp_count("_clean", F.lit(ANCHOR_START))) | F.exists("_tags", unclear)
    values = F.filter(F.transform("_tags", lambda t: F.regexp_extract(t, ADDRESS, 1)), lambda v: v != "")
    # the parser gets the html of odd pages only, and nulls for the others
    read = tags.select(key, F.when(odd, F.col(html)).alias("_odd"), F.transform(values, lambda v: F.trim(v, F.lit("\"'"))).alias("_plain"))
    page = read.select(key, "_odd", "_plain", markup.page_of("_odd").alias("page"))
    found = F.filter("page.elements", lambda e: (e["tag"] == "a") & markup.attribute(e, "href").isNotNull())
    return page.select(key, F.when(F.col("_odd").isNull(), F.col("_plain")).otherwise(F.transform(found, lambda e: markup.attribute(e, "href"))).alias("hrefs"))


def harvest(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, href, first_pos and n for each distinct link of a page.  A page is one
    row, so its links are counted in it: sorted, equal ones stand together, and
    where a run begins and the next one does says all."""
    numbered = F.transform("hrefs", lambda h, i: F.struct(h.alias("href"), (i + 1).cast("long").alias("pos")))
    page = hrefs_of(pages, key, html).where("size(hrefs) > 0").select(key, F.array_sort(numbered).alias("_links"))
    link = lambda i: F.element_at("_links", i)
    begins = F.filter(F.sequence(F.lit(1), F.size("_links")), lambda i: (i == 1) | (link(i)["href"] != link(F.greatest(i - 1, F.lit(1)))["href"]))
    page = page.withColumn("_begins", begins)
    after = lambda i: F.coalesce(F.try_element_at("_begins", i + 2), F.size("_links") + 1)
    return page.select(key, F.inline(F.transform("_begins", lambda b, i: F.struct(link(b)["href"].alias("href"), link(b)["pos"].alias("first_pos"), (after(i) - b).cast("long").alias("n")))))


def observed_links(pages: DataFrame, slug: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, title and url of the links to articles (below /slug/d/) of the page's
    own host; links that are too long or damaged are left out."""
    found = markup.elements(pages, key, html, ("a",)).select(key, F.col("attributes")["href"].alias("href"), F.col("text").alias("title"))
    joined = found.where("href is not null").join(pages.select(key, F.col(url).alias("_base")), key)
    full = joined.select(key, "title", "_base", urls.absolute("_base", "href").alias("url")).where(F.length("url") <= LONGEST_URL)
    inside = (urls.host(F.col("url")) == urls.host(F.col("_base"))) & F.col("url").rlike(rf"^https?://[^/?#]+/{slug}/d/[^?#]")
    return full.where(inside & ~F.contains("url", F.lit(REPLACEMENT)) & ~F.contains("title", F.lit(REPLACEMENT))).select(key, "title", "url").distinct()


def link_ids(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Ids by first occurrence in the page."""
    order = Window.partitionBy(key).orderBy("first_pos")
    return links.select(key, "href", F.dense_rank().over(order).cast("long").alias("link_id"))


def observe(pages: DataFrame, url: str = "url", order: str | None = None) -> DataFrame:
    """What the title index learns from seen URLs: identity, url, plain and ord,
    the column ``order`` as text (the URL itself without one)."""
    plain = urls.article_url(F.col(url))
    place = F.lpad(F.col(order).cast("string"), 20, "0") if order else F.col(url)
    return pages.select(plain.alias("identity"), F.col(url).alias("url"), (F.col(url) == plain).alias("plain"), place.alias("ord"))


def title_index(seen: DataFrame) -> DataFrame:
    """One row for each identity: url, url_source and the distinct observed URLs
    in order.  A URL seen plainly is preferred to one whose query was removed.

    The index of an index's own observations is that index, so merging is a
    union of observations."""
    first = seen.groupBy("identity", "url").agg(F.min("ord").alias("ord"), F.max("plain").alias("plain"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda s: s["url"])
    return first.groupBy("identity").agg(
        F.coalesce(F.min(F.when(F.col("plain"), F.col("url"))), F.first("identity")).alias("url"),
        F.when(F.max("plain"), "observed_url").otherwise("query_removed_from_observed_url").alias("url_source"),
        listed.alias("observed_urls"),
    )


def search_titles(index: DataFrame, wanted: str, limit: int = 8, title: str = "title", fuzzy: bool = True) -> DataFrame:
    """Titles equal to ``wanted``, then those that hold it, then close ones; by
    title and ``tie`` columns inside each; ``limit`` rows."""
    even = lambda c: F.translate(c, "～", "〜")
    text: Column = F.col(title)
    close = (even(text) == even(F.lit(wanted))) | (closeness(text, F.lit(wanted)) >= 0.6) if fuzzy else F.lit(False)
    rank = F.when(text == wanted, 0).when(F.contains(text, F.lit(wanted)), 1)
    native = index.withColumn("rank", rank)
    if fuzzy:  # only what the literal stages leave goes to Python
        native = native.where("rank is not null").unionByName(native.where("rank is null").where(close).withColumn("rank", F.lit(2)))
    others = [c for c in index.columns if c != title]
    return native.where("rank is not null").orderBy("rank", title, *others).limit(limit)


def damaged_candidates(index: DataFrame, url: str, column: str = "url", limit: int = 8) -> DataFrame:
    """URLs that a damaged one may have been: its sound pieces in order, with at
    least one character for each run of U+FFFD."""
    pieces = [p for p in url.split("�")]
    pattern = "^" + ".+".join("".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in p) for p in pieces) + "$"
    return index.where(F.col(column).rlike(pattern)).orderBy(column).limit(limit)
