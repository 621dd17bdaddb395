"""Hosts and page elements held against rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.functions import urls
from sparquill.functions.text import unescape

# Hosts by kind; a rule covers its subdomains.
HOSTS = {
    "ad": (
        "ad-stir.com microad.net microad.jp criteo.net criteo.com creativecarrer.com browsiprod.com gliacloud.com doubleclick.net"
        " googlesyndication.com googleadservices.com googletagservices.com adservice.google.com amazon-adsystem.com adnxs.com adsrvr.org"
        " pubmatic.com rubiconproject.com openx.net taboola.com outbrain.com i-mobile.co.jp imobile.co.jp nend.net zucks.net fluct.jp"
        " adingo.jp gmossp-sp.jp geniee.jp gsspat.jp logly.co.jp popin.cc ad-generation.jp impact-ad.jp yads.yahoo.co.jp yads.c.yimg.jp"
        " uncn.jp smartnews-ads.com"
    ).split(),
    "tracking": "googletagmanager.com google-analytics.com rainman.seesaawiki.jp b.st-hatena.com platform.twitter.com connect.facebook.net".split(),
    "affiliate": (
        "a8.net moshimo.com valuecommerce.com accesstrade.net afi-b.com linksynergy.com afl.rakuten.co.jp amzn.to felmat.net"
        " rentracks.jp affiliate.dmm.com al.dmm.com"
    ).split(),
}
# A shop's parameter that marks an affiliate link.
AFFILIATE_PARAMETER = {"amazon.co.jp": "tag", "amazon.com": "tag", "dmm.com": "af_id", "dmm.co.jp": "af_id"}

# Element rules, in the order in which they are tried.
AD_CLASSES = "adsense-box adsense-main-top adsense-main-inner side-adsense ad-extra ads-box adsbygoogle gliaplayer-container header-banner".split()
AD_IDS = ("adsense-location-top", "seesaa-bnr", "seesaa-bnr-close", "browsi-tag")
URL_ATTRIBUTES = ("href", "src", "data-src", "data-original", "data", "poster", "srcset", "data-srcset", "action")
AD_ID_PREFIXES = ("crt-",)
AD_DATA = ("data-revive-zoneid", "data-ad-client", "data-ad-slot")
CHROME_IDS = (
    "comment-box pageroot-form-box information-box page-social-link-top page-social-link-bottom page-posted page-attachedfile"
    " page-extra page-toplink page-tag-outer"
).split()
CHROME_CLASSES = ("comment-form-box",)
ARTICLE_CLASSES = ("user-area", "footer-footnote")
ARTICLE_CLASS_SET = frozenset(ARTICLE_CLASSES)
ARTICLE_IDS = ("page-body-inner", "page-body")


def host_rules(spark: SparkSession, hosts: dict[str, list[str]] | None = None) -> DataFrame:
    """rule and category; of kinds that list the same host ad goes first, then tracking."""
    hosts = hosts or HOSTS
    kinds = {h: k for k in ("affiliate", "tracking", "ad") for h in hosts.get(k, ())}
    return spark.createDataFrame(sorted(kinds.items()), "rule string, category string")


def host_categories(pages: DataFrame, rules: DataFrame, url: str = "url", allowed: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with host, rule and category of its URL.

    A host has few parent domains, so they are looked up by equality, the most
    specific first, in place of a suffix join.  Distinct hosts are classified
    once; the rule table decides by its size whether it is broadcast.
    """
    with_host = pages.withColumn("host", urls.host(F.col(url)))
    known = with_host.select("host").where("host is not null").distinct()
    allowed_host = F.col("host").isin(*allowed) if allowed else F.lit(False)
    tried = known.where(~allowed_host).select("host", F.posexplode(urls.parents(F.col("host"))).alias("depth", "rule"))
    hits = tried.join(rules, "rule").groupBy("host").agg(F.min_by(F.struct("rule", "category"), "depth").alias("hit"))
    found = with_host.join(hits, "host", "left").withColumn("rule", F.col("hit.rule"))
    shop = F.lit(None).cast("string")
    for domain, parameter in AFFILIATE_PARAMETER.items():
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & urls.query_value(F.col(url), parameter).isNotNull()
        shop = F.when(fits, "affiliate").otherwise(shop)
    return found.withColumn("category", F.coalesce("hit.category", F.when(~allowed_host, shop))).drop("hit")


def request_decision(url: Column, category: Column, allowed: tuple[str, ...]) -> Column:
    """allow, or why a request is refused.  Of the allowed hosts, one that begins with
    a dot stands for all hosts below that domain."""
    host = urls.host(url)
    fits = F.lit(False)
    for a in allowed:
        fits = fits | (F.endswith(host, F.lit(a)) if a.startswith(".") else host == a)
    inside = F.coalesce(fits, F.lit(False)) & F.startswith(url, F.lit("https://"))
    return F.when(inside, "allow").otherwise(F.coalesce(F.concat(category, F.lit(" host")), F.lit("outside the allowed hosts")))


def element_kind(classes: Column, element_id: Column, attributes: Column, host_rule: Column) -> Column:
    """kind/reason of a page element whose parts are columns, null if it stays; what
    ``element_rules.ElementRules.judge`` says of an element in a parser.

    ``classes``: array of tokens; ``attributes``: array of names in page order;
    ``host_rule``: of the ad host that it leads to.
    """
    which = lambda names: F.array_min(F.array_intersect(classes, F.array(*map(F.lit, names))))
    article = F.arrays_overlap(classes, F.array(*map(F.lit, ARTICLE_CLASSES))) | F.coalesce(element_id.isin(*ARTICLE_IDS), F.lit(False))
    prefix = F.lit(False)
    for p in AD_ID_PREFIXES:
        prefix = prefix | F.startswith(element_id, F.lit(p))
    data = F.try_element_at(F.filter(attributes, lambda a: a.isin(*AD_DATA)), F.lit(1))
    said = lambda kind, reason, detail: F.concat(F.lit(f"{kind}/{reason}:"), detail)
    return (
        F.when(article, None)
        .when(which(AD_CLASSES).isNotNull(), said("ad", "ad_class", which(AD_CLASSES)))
        .when(element_id.isin(*AD_IDS), said("ad", "ad_id", element_id))
        .when(prefix, said("ad", "ad_id_prefix", element_id))
        .when(data.isNotNull(), said("ad", "ad_attribute", data))
        .when(host_rule.isNotNull(), said("ad", "ad_host", host_rule))
        .when(element_id.isin(*CHROME_IDS), said("chrome", "chrome_id", element_id))
        .when(which(CHROME_CLASSES).isNotNull(), said("chrome", "chrome_class", which(CHROME_CLASSES)))
    )


def skipped_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, kind, reason, tag, line and ord of each element that the rules skip; what
    is inside a skipped element goes with it, as the parser notes only the outermost."""
    from sparquill.operators import markup

    page = pages.select(key, markup.page_of(html).alias("page"))
    found = page.select(key, F.inline(F.filter("page.elements", lambda e: e["skipped"].isNotNull())))
    return found.select(key, F.split_part("skipped", F.lit("/"), F.lit(1)).alias("kind"), F.regexp_extract("skipped", "/(.*)", 1).alias("reason"),
                        "tag", F.col("line").cast("long").alias("line"), F.col("node").cast("long").alias("ord"))


def skip_log(skipped: DataFrame, key: str = "page_id", samples: int = 40) -> DataFrame:
    """key, n, by_kind, by_reason, samples (the first ones, in page order) and
    truncated for each page on which something was skipped."""
    counted = skipped.groupBy(key, "kind", "reason").agg(F.count(F.lit(1)).alias("n"))
    by_reason = counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "kind", "reason"), "n")))).alias("by_reason"))
    by_kind = counted.groupBy(key, "kind").agg(F.sum("n").alias("n")).groupBy(key).agg(
        F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind")
    )
    first = Window.partitionBy(key).orderBy("ord")
    sampled = skipped.withColumn("place", F.row_number().over(first)).where(F.col("place") <= samples).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ord", "kind", "reason", "tag", "line"))).alias("samples")
    )
    return by_kind.join(by_reason, key).join(sampled, key).select(key, "n", "by_kind", "by_reason", "samples", (F.col("n") > samples).alias("truncated"))


def output_scan(fields: DataFrame, rules: DataFrame, key: str, paths: int = 5, most: int = 40) -> DataFrame:
    """key, bucket, url, n_paths, paths and bucket_count: ad and affiliate URLs in
    the texts of extracted fields.

    ``fields``: key, path, structural, text.  URLs of link and media fields are
    structural; an ad URL that is structural somewhere on the page is not a
    textual one as well.  ``paths`` are the smallest; ``most`` URLs of a bucket
    are listed, bucket_count counts all.
    """
    held = fields.where(F.contains("text", F.lit("//")))
    plain = F.coalesce(~F.contains("text", F.lit("&")), F.lit(True))
    texts = held.where(plain).unionByName(held.where(~plain).withColumn("text", unescape("text")))
    found = texts.select(key, "path", "structural", F.explode(urls.urls_in(F.col("text"))).alias("url"))
    address = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("https:"), F.col("url"))).otherwise(F.col("url"))
    judged = host_categories(found.withColumn("address", address), rules, "address").where(F.col("category").isin("ad", "affiliate"))
    uses = judged.groupBy(key, F.substring("url", 1, 300).alias("url"), "category", "path").agg(F.max("structural").alias("structural"))
    whole = Window.partitionBy(key, "url", "category")
    uses = uses.withColumn("shown", F.max("structural").over(whole))
    bucket = F.when(F.col("category") == "affiliate", "affiliate_urls").when(F.col("shown"), "ad_urls_structural").otherwise("ad_urls_textual")
    # of a structural URL only the structural paths are listed
    uses = uses.where((F.col("category") == "affiliate") | (F.col("structural") == F.col("shown"))).withColumn("bucket", bucket)
    ranked = uses.withColumn("place", F.row_number().over(Window.partitionBy(key, "bucket", "url").orderBy("path")))
    listed = ranked.groupBy(key, "bucket", "url").agg(
        F.count(F.lit(1)).alias("n_paths"), F.array_sort(F.collect_list(F.when(F.col("place") <= paths, F.col("path")))).alias("paths"))
    of_bucket = Window.partitionBy(key, "bucket")
    numbered = listed.withColumn("place", F.row_number().over(of_bucket.orderBy("url"))).withColumn("bucket_count", F.count(F.lit(1)).over(of_bucket))
    return numbered.where(F.col("place") <= most).drop("place")


def output_urls(texts: DataFrame, bucket: str, path: str, text: str, paths: int = 5) -> DataFrame:
    """bucket, url, n and up to ``paths`` smallest paths of each distinct URL in
    texts; texts without // never reach the pattern."""
    found = texts.where(F.contains(text, F.lit("//"))).select(bucket, path, F.explode(urls.urls_in(F.col(text))).alias("url"))
    uses = found.groupBy(bucket, "url", path).agg(F.count(F.lit(1)).alias("uses"))
    first = Window.partitionBy(bucket, "url").orderBy(path)
    listed = uses.withColumn("place", F.row_number().over(first)).where(F.col("place") <= paths)
    return uses.groupBy(bucket, "url").agg(F.sum("uses").alias("n")).join(
        listed.groupBy(bucket, "url").agg(F.array_sort(F.collect_list(F.col(path))).alias("paths")), [bucket, "url"]
    )


def attribute_hosts(elements: DataFrame, key: str, attribute: str = "value", name: str | None = None) -> DataFrame:
    """key and host of each URL of an attribute; only a srcset has several (without
    the column ``name`` of the attribute's name, all are taken for one)."""
    several = F.split(F.col(attribute), ",")
    parts = several if name is None else F.when(F.contains(name, F.lit("srcset")), several).otherwise(F.array(attribute))
    candidates = F.transform(parts, lambda u: F.split_part(F.trim(u), F.lit(" "), F.lit(1)))
    found = elements.select(key, F.explode(candidates).alias("url"))
    return found.select(key, urls.host(F.col("url")).alias("host")).where("host is not null").distinct()
