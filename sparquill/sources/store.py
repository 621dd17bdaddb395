"""A store of page responses that trusts no label: what goes in and what comes out is judged by its bytes.

A response is kept, and a stored one used, only if its request, place, form and
article are sound; its quality is worked out anew each time.  Every refusal is a
row with a code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import charset, text, urls
from sparquill.functions.text import REPLACEMENT
from sparquill.operators import articles, results
from sparquill.sources import snapshots
from sparquill.sources.pages import EVIDENCE, HTML_TYPES, SNIFFED

# The style sheet of the layout without the article, and the article's container.
LITE_STYLE, CONTAINER = "/css/wiki/lite/", "page-body-inner"
LINK_TAG = r"""(?is)<link\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
POLICIES = ("clean", "diagnostic")
SELECTORS = (articles.Selector(element_id=CONTAINER),)


def byte_view(raw: Column, content_type: Column) -> Column:
    """A body as text in which markup can be looked for before it is decoded: a
    character for each byte, and without the zero bytes where two or four bytes
    make a character, as a byte order mark or the content type says."""
    plain = F.decode(raw, "ISO-8859-1")
    mark = F.hex(F.substring(raw, 1, 4))
    wide = mark.rlike("^(FFFE|FEFF|0000FEFF)") | F.coalesce(F.lower(content_type).rlike(r"charset\s*=\s*[\"']?utf-?(16|32)"), F.lit(False))
    return F.when(wide, F.translate(plain, "\x00", "")).otherwise(plain)


def html_evidence(raw: Column, content_type: Column) -> Column:
    """Whether the first bytes of a body look like HTML, in whatever width."""
    return F.coalesce(byte_view(F.substring(raw, 1, SNIFFED), content_type).rlike(EVIDENCE), F.lit(False))


def mobile_layout(raw: Column, content_type: Column) -> Column:
    """Whether a page links the lite style sheet and lacks the article's container.
    References in the link's address count as what they stand for."""
    view = byte_view(raw, content_type)
    tags = F.array_join(F.regexp_extract_all(view, F.lit(LINK_TAG), F.lit(0)), "\n")
    linked = F.contains(F.coalesce(text.unescape(F.when(F.contains(tags, F.lit("&")), tags)), tags), F.lit(LITE_STYLE))
    return F.coalesce(linked & ~view.rlike(rf"(?i)\sid\s*=\s*[\"']?{CONTAINER}[\"'\s>]"), F.lit(False))


def form_error(now: Column, version: str, ttl: float) -> Column:
    """Null for a record whose form, age, request and place are sound, else its code."""
    m, same = F.col("metadata"), lambda a, b: F.coalesce(urls.identity(a) == urls.identity(b), F.lit(False))
    body = F.try_to_binary("html_base64", F.lit("base64"))
    kind = F.lower(F.trim(F.split_part(m["content_type"], F.lit(";"), F.lit(1))))
    base = urls.wiki_base(F.col("requested_url"))
    return (
        F.when(F.octet_length("html_base64") > 4 * ((charset.MAX_BODY + 2) // 3), "too_large")
        .otherwise(snapshots.record_error(version, now, ttl))
    ), (
        F.when(F.col("requested_user_agent").isNull(), "user_agent")
        .when(~same(m["requested_url"], F.col("requested_url")), "identity")
        .when(base.isNull() | ~F.coalesce(urls.wiki_base(m["url"]) == base, F.lit(False)), "scope")
        .when(m["content_type"].isNull() | m["fetched_at"].isNull(), "source")
        .when((kind != "") & ~kind.isin(*HTML_TYPES), "not_html")
        .when((kind == "") & ~html_evidence(body, m["content_type"]), "not_html")
    )


def judged(records: DataFrame, version: str, now: Column, ttl: float = snapshots.TTL_SECONDS, policy: str = "clean", selectors=SELECTORS) -> DataFrame:
    """``records`` (see ``snapshots.RECORD``) with code (null if usable), reasons and
    quality, both worked out from the bytes, and age in seconds.

    Bodies of records that fail by their form are neither decoded nor parsed.
    Codes beyond those of ``form_error``: mobile_layout, incomplete (no closed
    article, or one that shows nothing and gives no reason) and, under the policy
    clean, content_diagnostics."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    first, second = form_error(now, version, ttl)
    rows = records.withColumn("_form", F.coalesce(first, second)).withColumn("_raw", F.when(F.col("_form").isNull(), F.try_to_binary("html_base64", F.lit("base64"))))
    kind = F.col("metadata.content_type")
    rows = rows.withColumn("_mobile", mobile_layout(F.col("_raw"), kind)).withColumn("_decoded", charset.decode(F.col("_raw"), kind, F.lit(None).cast("string")))
    rows = rows.withColumn("_html", F.col("_decoded.text")).withColumn("_url", F.col("metadata.url"))
    rows = articles.with_article(rows, "_url", "_html", selectors)
    a = F.col("article")
    damaged = F.exists(a["lines"], lambda x: F.contains(x, F.lit(REPLACEMENT)))
    odd = F.col("_html").rlike(charset.SURROGATE_PAIR) | F.col("_html").rlike("&#[0-9]{4300}")
    reasons = F.array_compact(F.array(
        F.when(F.col("_decoded.lossy"), "byte_decode_replacements"), F.when(damaged, "article_replacements"),
        F.when(F.size(results.damaged_strings(a, articles.ARTICLE)) > 0, "structured_replacements"), F.when(odd, "character_reference_preprocessing")))
    rows = rows.withColumn("reasons", F.when(F.col("_form").isNull(), reasons))
    whole = a["closed"] & (articles.article_state(a) != "error")
    code = (
        F.when(F.col("_form").isNotNull(), F.col("_form")).when(F.col("_decoded.error_code").isNotNull(), F.col("_decoded.error_code"))
        .when(F.col("_mobile"), "mobile_layout").when(~F.coalesce(whole, F.lit(False)), "incomplete")
        .when((F.size("reasons") > 0) & F.lit(policy == "clean"), "content_diagnostics")
    )
    out = rows.withColumn("code", code).withColumn("quality", F.when(F.col("_form").isNull(), F.when(F.size("reasons") > 0, "diagnostic").otherwise("clean")))
    return out.withColumn("age", now.cast("double") - F.col("stored_at")).drop("_form", "_raw", "_mobile", "_decoded", "_html", "_url", "article")


def as_records(responses: DataFrame, version: str, now: Column) -> DataFrame:
    """``responses`` (requested_url, requested_user_agent, raw, metadata; other columns
    are kept) as records that are stored at ``now``."""
    return responses.select(
        "*", F.lit(1).alias("schema"), F.lit(version).alias("reader_version"), now.cast("double").alias("stored_at"), F.sha2("raw", 256).alias("sha256"), F.base64("raw").alias("html_base64")).drop("raw")


def store(responses: DataFrame, path: str, version: str, now: Column, policy: str = "clean", selectors=SELECTORS) -> DataFrame:
    """Appends the responses that ``judged`` finds usable, complete or not at all, and
    returns requested_url, requested_user_agent and code of the others.  A response
    whose encoding was set by hand (column ``overridden``, if there is one) is never stored."""
    rows = judged(as_records(responses, version, now), version, now, policy=policy, selectors=selectors)
    if "overridden" in responses.columns:
        rows = rows.withColumn("code", F.coalesce("code", F.when(F.col("overridden"), "explicit_override")))
    kept = [f.name for f in snapshots.RECORD]
    rows.where("code is null").select(*kept).write.mode("append").parquet(path)
    return rows.where("code is not null").select("requested_url", "requested_user_agent", "code")


def load(requests: DataFrame, records: DataFrame, version: str, now: Column, ttl: float = snapshots.TTL_SECONDS, policy: str = "clean", selectors=SELECTORS) -> DataFrame:
    """url, user_agent, code, quality, reasons, age, record: for each request (url,
    user_agent) its newest usable record, else the code of its newest one, or
    not_stored.  A request's record is one of the same address, but for fragment and
    case of escapes, and the same user agent."""
    asked = requests.select("url", "user_agent", urls.identity(F.col("url")).alias("_id")).distinct()
    held = records.withColumn("_id", urls.identity(F.col("requested_url"))).join(
        asked.select("_id", F.col("user_agent").alias("requested_user_agent")).distinct(), ["_id", "requested_user_agent"], "left_semi")
    rows = judged(held, version, now, ttl, policy, selectors)
    order = F.struct(F.col("code").isNull().alias("usable"), "stored_at", "sha256")
    best = rows.groupBy("_id", F.col("requested_user_agent").alias("user_agent")).agg(
        F.max_by(F.struct("code", "quality", "reasons", "age", F.struct(*[f.name for f in snapshots.RECORD if f.name != "quality"]).alias("record")), order).alias("b"))
    found = asked.join(best, ["_id", "user_agent"], "left")
    usable = F.col("b").isNotNull() & F.col("b.code").isNull()
    return found.select("url", "user_agent", F.when(F.col("b").isNull(), "not_stored").otherwise(F.col("b.code")).alias("code"), F.when(usable, F.col("b.quality")).alias("quality"),
                        F.when(usable, F.col("b.reasons")).alias("reasons"), F.when(usable, F.greatest("b.age", F.lit(0.0))).alias("age"), F.when(usable, F.col("b.record")).alias("record"))
