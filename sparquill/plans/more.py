"""More named queries with their SQL: functions, responses, lookups and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparquill.functions import charset, references, text, urls
from sparquill.operators import articles, audits, commands, corpus, markup, naming, notes, packs, results, rules, stories
from sparquill.plans.catalog import ARTICLES_SQL, LINES_SQL, _articles, _lines, _pages, query
from sparquill.sources import pages, snapshots, store
from sparquill.tables import table

# --- functions -----------------------------------------------------------------


@query("""with n as (select page_id, html, len(regexp_extract_all(html, '&middot;'))::bigint as dots, len(regexp_extract_all(html, '&copy;'))::bigint as signs, len(regexp_extract_all(html, '<article>'))::bigint as alts from pages)
  select page_id, dots + alts as eligible_pairs, dots + alts as joined_pairs, 2 * signs as unpaired, signs as normalized, dots + alts + 3 * signs as n_samples,
    sha256(replace(replace(replace(html, '&middot;', '😀'), '&copy;', '&#xD800;&#xDE00' || '&#169;'), '<article>', '<script>"&#xD83D;&#xDE00;"</script><!-- &#xD83D;&#xDE00; --><article><img alt="😀" src="&#xD83D;&#xDE00;">')) as digest from n""")
def reference_repairs(spark, d):
    """Pairs in text and alt are joined; in scripts, comments and addresses they stay; halves alone are counted, very long references written short."""
    pair = "&#xD83D;&#xDE00;"
    html = F.replace(F.replace("html", F.lit("&middot;"), F.lit("&#55357;&#x0DE00;")), F.lit("&copy;"), F.lit("&#xD800;&#xDE00" + "&#" + "0" * 150 + "169;"))
    html = F.replace(html, F.lit("<article>"), F.lit(f'<script>"{pair}"</script><!-- {pair} --><article><img alt="{pair}" src="{pair}">'))
    found = references.prepared(table(spark, d, "pages").select("page_id", html.alias("html")), mode="utf16")
    r = lambda c: F.col(f"references.{c}")
    return found.select("page_id", *[r(c).alias(c) for c in ("eligible_pairs", "joined_pairs", "unpaired", "normalized")], F.size(r("samples")).cast("long").alias("n_samples"), F.sha2("html", 256).alias("digest"))


@query("select doc_id, sha256(text) as digest, doc_id % 3 = 2 as marked, false as lossy from documents")
def page_decode(spark, d):
    """Texts as bodies: with a charset in the header, a byte order mark, or a meta element."""
    kind = F.col("doc_id") % 3
    body = (
        F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode("text", "UTF-16"))
        .otherwise(F.encode(F.concat(F.lit('<meta charset="utf-8">'), F.col("text")), "UTF-8"))
    )
    header = F.when(kind == 0, F.lit("text/html; charset=UTF-8")).otherwise(F.lit("text/html"))
    got = table(spark, d, "documents").select("doc_id", charset.decode(body, header, F.lit(None).cast("string")).alias("d"))
    plain = F.regexp_replace("d.text", '^<meta charset="utf-8">', "")
    return got.select("doc_id", F.sha2(plain, 256).alias("digest"), (F.col("d.encoding").isNotNull() & (plain != F.col("d.text"))).alias("marked"), F.col("d.lossy").alias("lossy"))


@query("""select doc_id, (length(text) - length(replace(text, 'é', '')))::bigint as literal, (length(text) - length(replace(text, 'ü', '')))::bigint as introduced
  from documents where contains(text, 'é') or contains(text, 'ü')""")
def replacement_origins(spark, d):
    """Replacement characters of the text itself, and bytes that no UTF-8 text holds."""
    rows = table(spark, d, "documents").where("contains(text, 'é') or contains(text, 'ü')")
    pairs = F.transform(F.split(F.replace("text", F.lit("é"), F.lit("�")), "ü"), lambda p: F.hex(F.encode(p, "UTF-8")))
    broken = F.unhex(F.array_join(pairs, "FF"))
    got = rows.select("doc_id", charset.decode(broken, F.lit("text/html; charset=utf-8"), F.lit(None).cast("string")).alias("d"))
    return got.select("doc_id", "d.literal", "d.introduced")


@query("select p_partkey, upper(replace(p_name, ' ', '')) || '1' as key, len(string_split(p_name, ' ')) as n_words, lower(split_part(p_name, ' ', 1)) as first from part")
def name_words(spark, d):
    """Full-width capitals and separators fold away."""
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "".join(chr(0xFF21 + i) for i in range(26)) + "・")
    found = table(spark, d, "part").select("p_partkey", text.fold(F.concat(wide, F.lit("_１"))).alias("key"), text.words(wide).alias("words"))
    return found.select("p_partkey", F.upper("key").alias("key"), F.size("words").cast("long").alias("n_words"), F.element_at("words", 1).alias("first"))


@query("select p_partkey, p_name || '|' || p_brand as names from part")
def split_names(spark, d):
    cell = F.concat(F.lit("「"), F.col("p_name"), F.lit("」（初期）*1、~~old~~／ "), F.col("p_brand"), F.lit("＊2"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_names(cell), "|").alias("names"))


@query("""select c_custkey, '@' || left(replace(c_name, '#', '_'), 12) || ' @' || c_nationkey::varchar as accounts,
    case when c_custkey % 2 = 0 then c_mktsegment end as reading from customer""")
def profile_rows(spark, d):
    rows = table(spark, d, "customer")
    handle = F.substring(F.replace("c_name", F.lit("#"), F.lit("_")), 1, 12)
    line = F.concat(F.lit("| X（旧Twitter） | @"), handle, F.lit(" / @"), F.col("c_nationkey").cast("string"), F.lit(" | @other |"))
    name = F.concat(F.lit("| [colspan=2] "), F.lower("c_name"), F.lit("（"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.upper("c_name")), F.lit("）*1 |"))
    lines = F.array(F.lit("| [colspan=2] someone（else） |"), name, line)
    return rows.select("c_custkey", F.array_join(text.accounts(lines), " ").alias("accounts"), text.reading(lines, F.col("c_name")).alias("reading"))


@query("select p_partkey, replace(p_name, ' ', '%20') as escaped from part")
def title_escapes(spark, d):
    return table(spark, d, "part").select("p_partkey", charset.title_escape("p_name").alias("escaped"))


@query("""select page_id, case when page_id % 2 = 0 then url else left(url, 12) || '~' end as label, split_part(split_part(url, '#', 1), '?', 1) || 'A%2F' as identity,
    'http://' || split_part(url, '/', 3) || '/x' as joined from pages""")
def url_parts(spark, d):
    cut = F.concat(F.substring("url", 1, 12), F.when(F.col("page_id") % 2 == 0, "...").otherwise("~"))
    plain = urls.article_url(F.col("url"))
    base = F.concat(F.lit("http://"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/a/b?c"))
    return table(spark, d, "pages").select(
        "page_id", text.expand_label(cut, F.col("url")).alias("label"), urls.article_identity(F.concat(plain, F.lit("%41%2f?q#f"))).alias("identity"),
        urls.absolute(base, F.lit("../x")).alias("joined"))


@query("select page_id, replace(url, '/', '<') as text from pages")
def unescaped(spark, d):
    return table(spark, d, "pages").select("page_id", text.unescape(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("/"), F.lit("&#60;"))).alias("text"))


@query("select page_id, lower(split_part(url, '/', 3)) as host from pages union select page_id, 'cdn.example' from pages")
def attribute_hosts(spark, d):
    value = F.concat(F.lit("//CDN.example/a.png 1x, "), F.col("url"), F.lit(" 2x"))
    return rules.attribute_hosts(table(spark, d, "pages").select("page_id", value.alias("value")), "page_id")


# --- requests and stored records -------------------------------------------------

@query("""select page_id, case when not starts_with(url, 'https://') or split_part(url, '/', 3) not like '%.org' then coalesce(case when split_part(url, '/', 3) like '%.net' then 'ad' end || ' host', 'outside the allowed hosts')
    else 'allow' end as decision from pages""")
def request_decisions(spark, d):
    host = urls.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", rules.request_decision(F.col("url"), F.when(host.like("%.net"), "ad"), (".org",)).alias("decision"))


@query("""with s as (select *, 'https://x.' || case page_id % 4 when 0 then 'doubleclick.net' when 1 then 'google-analytics.com' when 2 then 'a8.net' else 'amazon.co.jp' end
    || '/p' || case when page_id % 8 = 7 then '?tag=' else '?tag=t' end as u from pages)
  select page_id, case page_id % 4 when 0 then 'ad' when 1 then 'tracking' when 2 then 'affiliate' else case when page_id % 8 <> 7 then 'affiliate' end end as category from s""")
def shipped_hosts(spark, d):
    """The rules as they are shipped, with a shop's parameter that is set or empty."""
    n = F.col("page_id")
    name = F.element_at(F.array(*map(F.lit, ("doubleclick.net", "google-analytics.com", "a8.net", "amazon.co.jp"))), (n % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://x."), name, F.when(n % 8 == 7, "/p?tag=").otherwise("/p?tag=t"))
    rows = table(spark, d, "pages").select("page_id", url.alias("url"))
    return rules.host_categories(rows, rules.host_rules(spark)).select("page_id", "category")


@query("""select event_id, least(greatest(case when event_id % 3 = 0 then user_id::double when event_id % 3 = 1 then (epoch(date_trunc('second', ts)) - epoch(timestamp '2024-01-15 00:00:00'))::double end, 0), 1000000) as wait
  from events where event_id % 3 < 2""")
def retry_after(spark, d):
    date = F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    value = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, date).otherwise("soon")
    wait = snapshots.retry_after_seconds(value, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return table(spark, d, "events").select("event_id", wait.alias("wait")).where("wait is not null")


@query("""select doc_id, case when doc_id % 5 = 0 then 'schema' when doc_id % 7 = 0 then 'expired' when doc_id % 11 = 0 then 'status' when doc_id % 13 = 0 then 'digest' end as error from documents""")
def record_errors(spark, d):
    n = F.col("doc_id")
    body = F.encode("text", "UTF-8")
    record = table(spark, d, "documents").select(
        "doc_id", F.when(n % 5 == 0, 2).otherwise(1).alias("schema"), F.lit("v").alias("reader_version"), F.when(n % 7 == 0, 0.0).otherwise(99_000.0).alias("stored_at"),
        F.struct(F.when(n % 11 == 0, 404).otherwise(200).alias("http_status")).alias("metadata"), F.base64(body).alias("html_base64"),
        F.sha2(F.when(n % 13 == 0, F.encode(F.lit("x"), "UTF-8")).otherwise(body), 256).alias("sha256"))
    return record.select("doc_id", snapshots.record_error("v", F.lit(100_000).cast("timestamp")).alias("error"))


_STORE_FAULTS = ("schema", "version", "expired", "status", "digest", "identity", "scope", "source", "not_html", "mobile_layout", "incomplete", "content_diagnostics", "ok", "wide")


@query(f"""with n as (select *, page_id % {len(_STORE_FAULTS)} as k from pages)
  select page_id, case when k < 11 then list_value({", ".join(f"'{f}'" for f in _STORE_FAULTS)})[k + 1] when not contains(html, '</article>') then 'incomplete' when k = 11 then 'content_diagnostics' end as code,
    case when k >= 9 then case when k = 11 then 'diagnostic' else 'clean' end end as quality from n""")
def stored_records(spark, d):
    """The pages as stored records, each with one fault or none, judged by their bytes; the last kind is written in two bytes a character."""
    k, at = F.col("page_id") % len(_STORE_FAULTS), _STORE_FAULTS.index
    fault = lambda name, odd, usual: F.when(k == at(name), odd).otherwise(usual)
    url = F.concat(F.lit("https://w.example/wiki/d/"), F.col("page_id").cast("string"))
    html = F.when(k == at("mobile_layout"), F.concat(F.lit("<link rel=stylesheet href='/css&#x2f;wiki/lite/a.css'>"), F.col("html")))
    html = html.when(k == at("incomplete"), F.regexp_replace("html", "</?article>", "")).when(k == at("content_diagnostics"), F.replace("html", F.lit("</h1>"), F.lit("&#xFFFD;</h1>"))).otherwise(F.col("html"))
    body = F.when(k == at("wide"), F.encode(html, "UTF-16")).otherwise(F.encode(html, "UTF-8"))
    metadata = F.struct(
        fault("identity", F.lit("https://w.example/wiki/d/x"), url).alias("requested_url"), fault("scope", F.lit("https://w.example/other/d/x"), url).alias("url"),
        fault("status", F.lit(404), F.lit(200)).alias("http_status"), F.when(k == at("not_html"), "text/plain").when(k == at("wide"), "text/html").otherwise("text/html; charset=utf-8").alias("content_type"),
        fault("source", F.lit(None), F.lit("2024")).cast("string").alias("fetched_at"))
    rows = table(spark, d, "pages").select(
        "page_id", fault("schema", F.lit(3), F.lit(1)).alias("schema"), fault("version", F.lit("u"), F.lit("v")).alias("reader_version"), fault("expired", F.lit(0.0), F.lit(99_000.0)).alias("stored_at"),
        F.lit("clean").alias("quality"), url.alias("requested_url"), F.lit("agent").alias("requested_user_agent"),
        F.sha2(F.when(k == at("digest"), F.encode(F.lit("x"), "UTF-8")).otherwise(body), 256).alias("sha256"), F.base64(body).alias("html_base64"), metadata.alias("metadata"))
    return store.judged(rows, "v", F.lit(100_000).cast("timestamp"), selectors=(articles.Selector(tag="article"),)).select("page_id", "code", "quality")


@query("""select count(*) as seen, count(*) filter (doc_id % 5 > 0 and doc_id % 3 > 0 and doc_id % 7 > 0 and doc_id % 2 = 0) as reindexed,
    count(*) filter (doc_id % 5 > 0 and doc_id % 3 > 0 and doc_id % 7 > 0 and doc_id % 2 = 1) as other, count(*) filter (doc_id % 5 > 0 and doc_id % 3 = 0) as old,
    count(*) filter (doc_id % 5 > 0 and doc_id % 3 > 0 and doc_id % 7 = 0) as expired, count(*) filter (doc_id % 5 = 0) as invalid from documents""")
def rebuild_report(spark, d):
    n = F.col("doc_id")
    body = F.encode("text", "UTF-8")
    records = table(spark, d, "documents").select(
        F.when(n % 5 == 0, 2).otherwise(1).alias("schema"), F.when(n % 3 == 0, "u").otherwise("v").alias("reader_version"), F.when(n % 7 == 0, 0.0).otherwise(99_000.0).alias("stored_at"),
        F.struct(F.lit(200).alias("http_status")).alias("metadata"), F.base64(body).alias("html_base64"), F.sha2(body, 256).alias("sha256"),
        F.when(n % 2 == 0, "https://w/a/x").otherwise("https://w/b/x").alias("requested_url"))
    return snapshots.rebuild_report(records, "v", F.lit(100_000).cast("timestamp"), "https://w/a/")


@query("""select doc_id, case when doc_id % 7 = 0 then 'missing' when doc_id % 5 = 0 then 'extra' when doc_id % 3 = 0 then 'digest' else 'ok' end as status,
    doc_id % 7 > 0 and doc_id % 5 > 0 and doc_id % 3 > 0 as given from documents where doc_id % 35 > 0""")
def checked_files(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id").where("doc_id % 35 > 0")
    listed = docs.where("doc_id % 5 > 0").select("path", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("content")), 256).alias("sha256"))
    found = pages.checked(docs.where("doc_id % 7 > 0").select("path", "content"), listed)
    return found.select(F.col("path").cast("long").alias("doc_id"), "status", F.col("content").isNotNull().alias("given"))


@query("""with c as (select distinct l_orderkey, l_orderkey % 4 as q from lineitem)
  select l_orderkey, case when q = 2 then 'q2x' else '' end as candidates from c where q <> 1""")
def near_headings(spark, d):
    q = F.col("l_orderkey") % 4
    tables = table(spark, d, "lineitem").select("l_orderkey").distinct().select("l_orderkey", F.array(F.lit("order"), F.when(q == 1, "q").when(q == 2, "q2x").otherwise("z")).alias("path"))
    return corpus.near_headings(tables, "q", "l_orderkey").withColumn("candidates", F.array_join("candidates", " "))


@query("""select page_id, url, case when not starts_with(url, 'http') then null else split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4) || '/' end as base,
    split_part(url, '/', 4) as slug, 'a b' || chr(12354) as title from pages""")
def wiki_addresses(spark, d):
    article = F.concat(F.array_join(F.slice(F.split("url", "/"), 1, 4), "/"), F.lit("/d/a%20b%a4%a2?x#y"))
    return table(spark, d, "pages").select("page_id", "url", urls.wiki_base(F.col("url")).alias("base"), urls.wiki_slug(F.col("url")).alias("slug"), urls.article_title(article).alias("title"))


@query("""select doc_id, case when doc_id % 5 = 0 then false else doc_id % 3 > 0 end as valid from documents""")
def slug_checks(spark, d):
    slug = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("wiki/"), "source")).otherwise(F.concat(F.when(F.col("doc_id") % 3 == 0, "x-").otherwise("WIKI-"), F.col("source")))
    return table(spark, d, "documents").select("doc_id", urls.slug_is_valid(slug, "wiki").alias("valid"))


@query("""select doc_id, (doc_id % 4 > 0 and doc_id % 5 > 0) as clean, doc_id % 4 > 0 as diagnostic from documents""")
def storable(spark, d):
    n = F.col("doc_id")
    asked = lambda policy: pages.storable(F.lit(200), n % 4 > 0, F.lit(False), F.lit(False), n % 5 == 0, policy)
    return table(spark, d, "documents").select("doc_id", asked("clean").alias("clean"), asked("diagnostic").alias("diagnostic"))


@query("""select page_id, case when page_id % 3 = 0 and page_id % 2 = 0 then 'b' else 'a' end as body, page_id % 3 = 0 and page_id % 2 = 0 as layout_fallback from pages""")
def desktop_layouts(spark, d):
    first = table(spark, d, "pages").select("page_id", F.lit("a").alias("body"))
    second = table(spark, d, "pages").where("page_id % 2 = 0").select("page_id", F.lit("b").alias("body"))
    return pages.prefer_desktop(first, second, "page_id", F.col("page_id") % 3 == 0)


@query("""select doc_id, case when doc_id % 6 = 0 then 'line' when doc_id % 6 = 1 then 'line' when doc_id % 6 in (2, 3) and doc_id - doc_id % 6 + 3 <= (select max(doc_id) from documents) then 'duplicate' end as error
  from documents""")
def manifest_lines(spark, d):
    n = F.col("doc_id")
    path = F.when(n % 6 == 0, F.lit("../x")).when(n % 6 == 1, F.lit("a\\b")).when(n % 6 < 4, F.concat(F.lit("p/"), (n - n % 6).cast("string"))).otherwise(F.concat(F.lit("q/"), n.cast("string")))
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), path.alias("path"))
    parsed = snapshots.parse_manifest(docs.select(F.concat_ws("  ", "sha256", "path").alias("value")))
    return docs.join(parsed, ["sha256", "path"]).select("doc_id", "error").distinct()


# --- articles --------------------------------------------------------------------

@query("""with b as (select page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<br>')) as x from pages)
  select page_id, count(*) as n, 1::bigint as n_urls from b group by page_id""")
def article_images(spark, d):
    """Every line break of an article as an image."""
    marked = F.replace("html", F.lit("<br>"), F.lit("<img src='../i.png' alt='pic'>"))
    found = articles.child(articles.parse_pages(table(spark, d, "pages").select("page_id", "url", marked.alias("html"))), "images")
    return found.where("alt = 'pic' and url like 'http%/i.png'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("n_urls"))


@query("""with p as (select page_id, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) as body from pages)
  select page_id, 1::bigint as link_id, len(regexp_extract_all(body, '<p>'))::bigint as n_lines, case when len(regexp_extract_all(body, '<p>')) > 0 then '/a|a' end as originals
  from p where contains(body, '<p>')""")
def article_links(spark, d):
    """A link behind the first line of every paragraph, written in two ways: how many lines hold it, and both ways."""
    site = F.nullif(F.regexp_extract("url", "^https?://[A-Za-z0-9.-]+(?=[:/?#]|$)", 0), F.lit(""))
    marked = F.replace("html", F.lit("<p>"), F.lit("<p>x<br><A HREF='/a'>l</A> <a href=a>m</a>"))
    page = articles.parse_pages(table(spark, d, "pages").select("page_id", F.concat(F.coalesce(site, F.lit("http://h")), F.lit("/x")).alias("url"), marked.alias("html")))
    return articles.linked(page).select("page_id", "link_id", "n_lines", F.array_join("original_hrefs", "|").alias("originals"))


@query(f"""with {ARTICLES_SQL} select page_id, 'ok' as status, string_agg(line::varchar || ': ' || text, chr(10) order by line) as text from article where line <= 3 group by page_id""")
def rendered_pages(spark, d):
    return commands.rendered(commands.read(_articles(spark, d), count=3))


#: The test pages with notes, links, a table, metadata and furniture, and what their articles' lines are then.
_RICH_SQL = ARTICLES_SQL.replace("from pages)", "from rich)")


def _rich(spark, d):
    html, swap = F.col("html"), lambda h, old, new: F.replace(h, F.lit(old), new if not isinstance(new, str) else F.lit(new))
    said = F.when(F.col("page_id") % 2 == 0, "first").otherwise(F.split_part("url", F.lit("/"), F.lit(3)))
    html = swap(html, "<p>", "<p><a href='/a'>l</a>")
    html = swap(html, "<h1>", "<h1><a href='#footer-footnote1' title='first'>*1</a> ")
    html = swap(html, "</h1>", "</h1><table><tr><td>c<a href='/t'>q</a></td></tr></table>")
    html = swap(html, "<article>", "<article><div id='comment-box'>box</div><a href='https://ad.doubleclick.net/x'>ad</a><div id=crt-1>crt</div>")
    html = swap(html, "<nav", F.concat(F.lit("<p class=update>最終更新：2020</p><ul id=page-tags><li>t1</li><li>t1</li></ul><ul class=footer-footnote><li><a id=footer-footnote1>*1</a>: "), said, F.lit("</li></ul><nav")))
    html = swap(html, "&middot;", "&#xFFFD;&#0;")
    return _pages(spark, d).select("page_id", "url", html.alias("html"))


@query(f"""with rich as (select page_id, url, replace(replace(replace(html, '<p>', '<p>l [2] '), '<h1>', '<h1>*1 '), '</h1>', '</h1>| cq [1] |<br>') as html from pages), {_RICH_SQL},
  g as (select page_id, count(*) as total_lines, bool_or(line <= 5 and starts_with(text, 'l [2] ')) as linked,
      string_agg(line::varchar || ': ' || text, chr(10) order by line) filter (where line <= 5) as lines from article group by page_id)
  select g.page_id, 'ok' as status, 'text' as article_state, total_lines, least(total_lines, 5) as returned_lines, lines, false as more_before, total_lines > 5 as more_after,
    '1=' || regexp_extract(url, '^[^/]*//[^/]*') || '/t' || case when linked then ' 2=' || regexp_extract(url, '^[^/]*//[^/]*') || '/a' else '' end as links, '1.1.1=cq [1]' as cells,
    '1 ' || case when page_id % 2 = 0 then 'match' else 'conflict' end || ' referenced text ' || case when page_id % 2 = 0 then 'first' else split_part(url, '/', 3) end as notes,
    '1' as selected_notes, '2020' as last_updated, 't1' as tags, 1::bigint as total_tables, 2::bigint as ads_skipped, 1::bigint as chrome_skipped,
    len(regexp_extract_all(p.html, '&middot;'))::bigint as explicit_references, len(regexp_extract_all(p.html, '&middot;'))::bigint as invalid_references,
    (page_id % 2)::bigint + (contains(p.html, '&middot;'))::bigint as n_warnings from g join pages p using (page_id)""")
def page_results(spark, d):
    """Lines, links, table, notes, metadata and audits of every page from one reading of it."""
    found = results.assemble(articles.read_pages(_rich(spark, d)), count=5, with_tables=True)
    joined = lambda rows, said, sep: F.array_join(F.transform(rows, said), sep)
    number = lambda c: c.cast("string")
    return found.select(
        "page_id", "status", "article_state", "total_lines", "returned_lines", joined("lines", lambda x: F.concat(number(x["line"]), F.lit(": "), x["text"]), "\n").alias("lines"),
        "more_before", "more_after", joined("links", lambda x: F.concat(number(x["link_id"]), F.lit("="), x["href"]), " ").alias("links"),
        joined("cells", lambda x: F.concat(F.concat_ws(".", number(x["table_idx"]), number(x["row_idx"]), number(x["cell_idx"])), F.lit("="), x["text"]), " ").alias("cells"),
        joined("notes", lambda x: F.concat_ws(" ", number(x["number"]), x["agreement"], x["reference_state"], x["definition_state"], x["text"]), ";").alias("notes"),
        F.array_join(F.col("selected_notes").cast("array<string>"), ",").alias("selected_notes"), "last_updated", F.array_join("tags", ",").alias("tags"), "total_tables", "ads_skipped", "chrome_skipped",
        F.col("reference_audit.explicit").alias("explicit_references"), F.col("reference_audit.invalid").alias("invalid_references"),
        F.size(F.filter("warnings", lambda w: ~F.contains(w, F.lit("not closed")))).cast("long").alias("n_warnings"))


@query(f"""with rich as (select page_id, url, replace(replace(replace(html, '<p>', '<p>l [2] '), '<h1>', '<h1>*1 '), '</h1>', '</h1>| cq [1] |<br>') as html from pages), {_RICH_SQL},
  g as (select page_id, count(*) as total, string_agg(line::varchar || ': ' || text, chr(10) order by line) filter (where line <= 3) as lines, count(*) filter (where line <= 3) as n from article group by page_id)
  select page_id, '# ' || replace(replace(replace(replace(trim(regexp_extract(p.html, '<title>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') || chr(10) || 'lines: ' || total::varchar || '; returned: ' || n::varchar || '; more after: ' || (total > 3)::varchar || chr(10)
    || 'skipped: 2 ads, 1 page furniture' || chr(10) || 'updated: 2020' || chr(10) || 'tags: t1' || chr(10) || lines || chr(10) || 'tables:' || chr(10) || '1.1.1: cq [1]' || chr(10)
    || 'footnotes:' || chr(10) || '*1: ' || case when page_id % 2 = 0 then 'first' else split_part(url, '/', 3) || chr(10) || 'conflicting footnotes: 1' end as text
  from g join pages p using (page_id)""")
def rendered_results(spark, d):
    """The answer as text, down to the links."""
    text = results.rendered(results.assemble(articles.read_pages(_rich(spark, d)), count=3, with_tables=True))
    return text.select("page_id", F.split_part("text", F.lit("\nlinks:\n"), F.lit(1)).alias("text"))


@query(f"""with rich as (select page_id, url, html from pages), {_RICH_SQL}
  select page_id, line, text from article""")
def article_lines_without_furniture(spark, d):
    """Comment boxes, slots by id, attribute and host, and areas in them, leave no line."""
    junk = ("<div id='comment-box'>box<div class='ad-extra'>in it</div></div><p id=crt-77>crt</p><ul class='x comment-form-box'><li>form</ul><div data-x=1 data-ad-slot=2>slot</div>"
            "<a href='//x.nend.net/1'>ad</a><a href=https://Sub.DoubleClick.net:80/x>ad</a><span class='b ads-box'>box</span><div id='page-posted'>posted</div>")
    html = F.replace(F.replace("html", F.lit("<article>"), F.lit("<article>" + junk)), F.lit("</h1>"), F.lit("</h1>" + junk))
    return articles.lines(articles.parse_pages(_pages(spark, d).select("page_id", "url", html.alias("html"))))


_BODIES = {  # what an article holds, and the state that it is in then
    "<article> </article>": "empty", "<article><img src=a></article>": "no_extractable_text", "<article>x</article>": "text", "<p>x</p>": "error",
    "<article><video></video></article>": "no_extractable_text", "<article><form><input></form></article>": "error", "<article><form><input></form><hr></article>": "no_extractable_text",
    "<article><iframe src=a>x</iframe></article>": "no_extractable_text", "<article><div id=comment-box>x</div></article>": "no_extractable_text", "<article><script>x</script></article>": "empty",
    "<article>": "error", "<article><table></table></article>": "no_extractable_text", "<article><div class=user-area></div></article>": "empty", "<article><select><option></select></article>": "error",
}


@query(f"""select page_id, coalesce(case page_id % {2 * len(_BODIES)} {" ".join(f"when {2 * i + 1} then '{v}'" for i, v in enumerate(_BODIES.values()))} end,
    case when contains(html, '<article>') then 'text' else 'error' end) as article_state from pages""")
def article_evidence(spark, d):
    """Real articles, and between them ones that hold media, forms, skipped or no text, or do not end."""
    n = F.col("page_id") % (2 * len(_BODIES))
    body = F.try_element_at(F.array(*map(F.lit, _BODIES)), ((n + 1) / 2).cast("int"))
    page = table(spark, d, "pages").select("page_id", "url", F.when(n % 2 == 0, F.col("html")).otherwise(F.concat(F.regexp_replace("html", "(?s)<article>.*", ""), body)).alias("html"))
    return articles.empty_state(articles.parse_pages(page)).select("page_id", "article_state")


@query("""select page_id, case page_id % 4 when 0 then 'empty' when 1 then 'no_extractable_text' when 2 then 'text' else 'error' end as article_state from pages""")
def article_states(spark, d):
    body = F.element_at(F.array(*map(F.lit, ("<article> </article>", "<article><img src=a></article>", "<article>x</article>", "<p>x</p>"))), (F.col("page_id") % 4 + 1).cast("int"))
    page = table(spark, d, "pages").select("page_id", "url", F.concat(F.regexp_replace("html", "(?s)<article>.*", ""), body).alias("html"))
    return articles.empty_state(articles.parse_pages(page)).select("page_id", "article_state")


@query("""select page_id, count(*) as n, count(*) filter (tag = 'p') as paragraphs, count(*) filter (tag = 'a') as links from (
    select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '<x>', 'g'), '<([a-z0-9]+)[ >]', 1)) as tag from pages) where tag <> 'x' group by page_id""")
def page_elements(spark, d):
    found = markup.elements(table(spark, d, "pages")).where("tag not in ('script', 'style')")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag") == "a").alias("links"))


# --- audits, names, corpus ---------------------------------------------------------

@query("""with t as (select doc_id, '/a/0/text' as path, replace(text, 'é', chr(65533)) as v from documents union all select doc_id, '/a/1/text', replace(source, 's', chr(65533)) from documents
    union all select doc_id, '/m/x~1y', replace(lang, 'f', chr(65533)) from documents)
  select doc_id, path, (length(v) - length(replace(v, chr(65533), '')))::bigint as n, count(*) over (partition by doc_id) as n_values from t where contains(v, chr(65533))""")
def damaged_strings(spark, d):
    damage = lambda c, letter: F.replace(c, F.lit(letter), F.lit("�"))
    rows = table(spark, d, "documents").select(
        "doc_id", F.array(F.struct(damage("text", "é").alias("text"), F.lit(1).alias("n")), F.struct(damage("source", "s").alias("text"), F.lit(2).alias("n"))).alias("a"),
        F.create_map(F.lit("x/y"), damage("lang", "f")).alias("m"))
    return audits.damaged_strings(rows, "doc_id", ["a", "m"]).select("doc_id", "path", "n", "n_values")


@query("""with k as (select lower(replace(p_name, ' ', '')) as key, p_brand as slug from part group by all), o as (select key, count(*) as owners from k where length(key) between 2 and 24 group by key)
  select count(*) as total, count(*) filter (owners = 1) as nicknames, count(*) filter (owners > 1) as ambiguous from o""")
def name_index_counts(spark, d):
    part = table(spark, d, "part")
    found = naming.nickname_keys(part.select(F.col("p_brand").alias("slug"), F.col("p_name").alias("original")), part.limit(0).select(F.col("p_name").alias("key")), text.fold)
    return audits.counts(found, nicknames=F.col("status") == "nickname", ambiguous=F.col("status") == "ambiguous")


@query("""with n(name, generic) as (values ('先輩', true), ('ｓｅｎｐａｉ', false), ('お姉ちゃん', true))
  select p_partkey, name, case when generic then 'generic' else 'not_found' end as status from part cross join n""")
def generic_names(spark, d):
    asked = table(spark, d, "part").select("p_partkey", F.explode(F.array(*map(F.lit, ("先輩", "ｓｅｎｐａｉ", "お姉ちゃん")))).alias("name"))
    asked = asked.select(F.concat_ws("#", "p_partkey", "name").alias("qid"), F.col("name").alias("query"), text.fold("name").alias("key"))
    keys = table(spark, d, "region").select(text.fold("r_name").alias("key"), F.col("r_name").alias("slug"), F.lit("name").alias("kind"))
    found = naming.resolve(asked, keys, keys.select(F.col("key").alias("word"), "slug"))
    return found.select(F.split_part("qid", F.lit("#"), F.lit(1)).cast("long").alias("p_partkey"), F.col("query").alias("name"), "status")


_EVERYONE_SQL = """names as (select c_custkey as k, lower(c_mktsegment) || c_nationkey::varchar || 'x' || c_custkey::varchar as name, c_custkey::varchar as slug, lower(c_mktsegment) as nick from customer),
  asked as (select k as qid, case k % 6 when 0 then name when 1 then nick when 2 then left(name, length(name) - 1) when 3 then right(name, 5) when 4 then nick || 'zz' || k::varchar else 'x' || k::varchar end as key from names)"""


@query(f"""with {_EVERYONE_SQL}, keys as (select distinct key from asked),
  nicks as (select nick as key, string_agg(distinct slug, ',' order by slug) as slugs, count(distinct slug) as n from names group by nick having count(distinct slug) < 200),
  hits as (
    select key, slug, 1 as stage from keys join names on name = key
    union select k.key, n.slug, 2 from keys k join nicks using (key) join names n on n.nick = k.key
    union select k.key, n.slug, 3 from keys k join names n on starts_with(n.name, k.key) where length(k.key) >= 3
    union select k.key, n.slug, 4 from keys k join names n on contains(n.name, k.key)),
  best as (select *, min(stage) over (partition by key) as first from hits),
  c as (select key, first, count(distinct slug) as n, min(slug) as slug from best where stage = first group by key, first)
  select qid, first::bigint as stage, case when n is null then 'not_found' when n > 1 then 'ambiguous' else 'ok' end as status, coalesce(n, 0) as n_candidates, slug as first_slug
  from asked left join c using (key)""")
def everyone_resolved(spark, d):
    """A name for every customer, and as many queries: whole names, nicknames of many, beginnings, ends, parts and unknown ones."""
    k, nick = F.col("c_custkey"), F.lower("c_mktsegment")
    people = table(spark, d, "customer").select(k.alias("k"), F.concat(nick, F.col("c_nationkey").cast("string"), F.lit("x"), k.cast("string")).alias("name"), k.cast("string").alias("slug"), nick.alias("nick"))
    n = F.col("k") % 6
    key = (
        F.when(n == 0, F.col("name")).when(n == 1, F.col("nick")).when(n == 2, F.expr("left(name, length(name) - 1)")).when(n == 3, F.expr("right(name, 5)"))
        .when(n == 4, F.concat("nick", F.lit("zz"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("x"), F.col("k").cast("string")))
    )
    asked = people.select(F.col("k").alias("qid"), key.alias("query"), key.alias("key"))
    strong = people.select(F.col("name").alias("key"), "slug", F.lit("name").alias("kind"))
    owned = naming.nickname_keys(people.select("slug", F.col("nick").alias("original")), strong, lambda c: c).where("size(slugs) < 200")
    found = naming.resolve(asked, naming.name_keys(strong, owned), people.select(F.col("name").alias("word"), "slug"))
    return found.select("qid", "stage", "status", F.size("slugs").cast("long").alias("n_candidates"), F.try_element_at("slugs", F.lit(1)).alias("first_slug"))


@query("""with parts as (select distinct replace(p_name, ' ', '') as name from part),
  asked as (select name, substr(name, 1, 1 + pos) || 'q' || substr(name, 3 + pos) as key from parts, (values (0), (2), (4)) as p(pos)),
  s as (select a.key, b.name as other, round(1 - levenshtein(a.key, b.name)::double / greatest(length(a.key), length(b.name)), 9) as score from (select distinct key from asked) a cross join parts b),
  r as (select *, row_number() over (partition by key order by score desc, other) as place from s where score >= 0.7)
  select name || '/' || a.key as qid, other as slug, score from asked a join r using (key) where place <= 5""")
def everyone_suggested(spark, d):
    """Every part's name misspelt in three places, against all names."""
    parts = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("name")).distinct()
    misspelt = parts.select("name", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))).alias("pos"))
    key = F.concat(F.substring("name", F.lit(1), F.col("pos") + 1), F.lit("q"), F.substring("name", F.col("pos") + 3, F.lit(99)))
    asked = misspelt.select(F.concat_ws("/", "name", key).alias("qid"), key.alias("key"))

    def similarity(a, b):
        return F.round(1 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b)), 9)

    return naming.suggest(asked, parts.select(F.col("name").alias("key"), F.col("name").alias("slug")), similarity=similarity, keys_most=1 << 30)


@query("""select n_nationkey::bigint as qid, n_name as query, 1::bigint as stage, r_name as region from nation join region on n_regionkey = r_regionkey""")
def profile_lookup(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    keys = nation.select(text.fold("n_name").alias("key"), F.col("n_name").alias("slug"), F.lit("name").alias("kind"))
    asked = nation.select(F.col("n_nationkey").cast("long").alias("qid"), F.col("n_name").alias("query"), text.fold(F.lower("n_name")).alias("key"))
    found = naming.resolve(asked, keys, keys.select(F.col("key").alias("word"), "slug"))
    return corpus.profiles_of(found, nation.select(F.col("n_name").alias("slug"), F.col("r_name").alias("region"))).select("qid", "query", "stage", "region")


@query("""with m as (select source, count(*) filter (n_chars <= 500) as missing, count(*) filter (n_chars >= 3000) as unreferenced from documents group by source)
  select source, missing, unreferenced from m where missing + unreferenced > 0""")
def note_diagnostics(spark, d):
    docs = table(spark, d, "documents")
    marked = docs.where("n_chars < 3000").select("source", F.col("doc_id").alias("number"), F.col("lang").alias("title"))
    listed = docs.where("n_chars > 500").select("source", F.col("doc_id").alias("number"), F.col("lang").alias("text"), F.lit(1).alias("ord"))
    found = notes.diagnose(notes.reconcile(marked, listed, "source"), "source")
    return found.select("source", F.size("missing").cast("long").alias("missing"), F.size("unreferenced").cast("long").alias("unreferenced")).where("missing + unreferenced > 0")


@query("""with s as (select source, doc_id, n_chars, case when n_chars % 3 = 0 then '' else lang end as text, (n_chars % 4)::varchar as heading from documents)
  , r as (select *, case heading when '2' then 1 when '0' then 2 when '3' then 3 end as rank from s where text <> '' and heading in ('2', '0', '3')),
  f as (select source, doc_id, heading, text, rank > 1 as fallback from r)
  select * from f""")
def section_by_priority(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.col("lang")).alias("text"), (F.col("n_chars") % 4).cast("string").alias("heading"))
    found = packs.first_filled(rows.select("doc_id", "heading", "text"), "doc_id", ["2", "0", "3"])
    return rows.select("source", "doc_id").join(found, "doc_id")


@query(f"""with {LINES_SQL}, names as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as name from benchmark),
  words as (select doc_id, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as name from lines)
  select distinct w.doc_id, w.line, w.name from words w join names using (name)""")
def mentions_of_many(spark, d):
    """Every word of the benchmark's texts as a name, in every line of the documents."""
    names = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("name")).distinct()
    return packs.co_mentions(_lines(spark, d), names, "doc_id")


@query(f"""with {LINES_SQL}, k as (select distinct case when length(p_name) % 2 = 0 then 'even' else 'odd' end as kind, left(p_name, 3) as pattern from part),
  t as (select distinct doc_id, kind, line, text from lines join k on contains(text, pattern)),
  a as (select *, row_number() over (partition by doc_id, kind order by line) as n from t)
  select doc_id, kind, line, text from a where n <= 3""")
def reactions_to_many(spark, d):
    """Beginnings of the parts' names as keywords of two kinds, some of both."""
    kinds = table(spark, d, "part").select(F.when(F.length("p_name") % 2 == 0, "even").otherwise("odd").alias("kind"), F.substring("p_name", 1, 3).alias("pattern")).distinct()
    return packs.reactions(_lines(spark, d), kinds, "doc_id", per_kind=3)


@query("""with r as (select source, doc_id, row_number() over (partition by source order by doc_id) as ord, count(*) over (partition by source) as n,
    sum(n_chars) over (partition by source)::bigint as total from documents)
  select source, doc_id, (total % (3 * n) >= ord)::bigint + (total % (3 * n) >= n + ord)::bigint as level from r""")
def pack_upgrades(spark, d):
    """Each source's documents may grow twice by ten characters; most packs have room for some of that."""
    docs = table(spark, d, "documents")
    whole = Window.partitionBy("source")
    total, n = F.sum("n_chars").over(whole), F.count(F.lit(1)).over(whole)
    items = docs.select("source", F.col("doc_id").alias("item"), F.col("doc_id").alias("ord"), F.lit(0).alias("level"), (total + total % (3 * n) * 10).alias("limit"),
                        F.transform(F.array(F.lit(0), F.lit(10), F.lit(20)), lambda x: (F.col("n_chars") + x).cast("long")).alias("sizes"))
    return packs.upgrade(items, "source").select("source", F.col("item").alias("doc_id"), "level")


_CUTS = {"cameo": 100, "brief": 800, "normal": 2000, "full": 4000, "ace": 100_000}
_PLAN_SQL = f"""members as (select source as pack, doc_id::varchar as name, row_number() over (partition by source order by doc_id) as place, text from documents),
  limits as (select pack, (least(120000 + 15000 * (count(*) - 1), 300000) / 3)::bigint as limit_, count(*) as n from members group by pack),
  extra as (select pack, name, coalesce(sum(length(l)), 0)::bigint as extra from (
      select pack, name, unnest(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'tion'))[1:2]) as l from members) group by pack, name),
  own as (select m.pack, name, place, [{", ".join(f"length(left(text, {v}))" for v in _CUTS.values())}] as sizes, coalesce(extra, 0) as extra from members m left join extra using (pack, name)),
  pairs as (select a.pack, length(a.name || ' and ' || b.name) as size from members a join members b on a.pack = b.pack and b.place = a.place + 1),
  sums as (select pack, [{", ".join(f"sum(sizes[{i}])" for i in range(1, 6))}] as items, sum(extra) as extra from own group by pack),
  of_pairs as (select pack, sum(size) as one from pairs group by pack),
  tiers(rank, item, pairs_) as (values {", ".join(f"({n}, {list(_CUTS).index(i) + 1}, {1 if p == 'names' else 2})" for n, (i, p) in enumerate(packs.TIERS, 1))}),
  sized as (select pack, rank, item, pairs_, items[item] + extra + pairs_ * coalesce(one, 0) as size, pairs_ * coalesce(one, 0) as pair_size from sums left join of_pairs using (pack) cross join tiers),
  chosen as (select pack, limit_, coalesce(min(rank) filter (where size <= limit_), 99)::bigint as tier, coalesce(min(rank) filter (where size <= limit_), min_by(rank, (size, rank))) as rank from sized join limits using (pack) group by pack, limit_),
  begun as (select c.pack, c.tier, c.rank, c.limit_, s.item, s.pair_size, c.limit_ - s.size as room from chosen c join sized s using (pack, rank)),
  rec as (
    with recursive r(pack, step, room, levels) as (
      select pack, 0::bigint, room::bigint, list_transform(range(n), lambda i: item::bigint) from begun join limits using (pack) where tier <> 99
      union all
      select r.pack, step + 1, case when up then room - cost else room end, case when up then list_transform(levels, lambda x, i: case when i = o.place then x + 1 else x end) else levels end from r
      join lateral (select o.place, o.sizes[levels[o.place] + 1] - o.sizes[levels[o.place]] as cost, levels[o.place] < 5 and o.sizes[levels[o.place] + 1] - o.sizes[levels[o.place]] <= room as up
        from own o where o.pack = r.pack and o.place = step % len(levels) + 1) o on true
      where step < 5 * len(levels))
    select pack, levels from r where step = 5 * len(levels))"""


def _story_plan(spark, d):
    order = Window.partitionBy("source").orderBy("doc_id")
    docs = table(spark, d, "documents").select(F.col("source").alias("pack"), F.col("doc_id").cast("string").alias("name"), F.row_number().over(order).alias("place"), "text",
                                               F.lead(F.col("doc_id").cast("string")).over(order).alias("next"))
    limit = (packs.automatic_budget(F.count(F.lit(1)).over(Window.partitionBy("pack"))) / 3).cast("decimal(20,0)").cast("long")
    cast = docs.select("pack", "name", "place", limit.alias("limit"))
    details = F.explode(F.array(*[F.struct(F.lit(k).alias("detail"), F.lit(v).alias("cap")) for k, v in _CUTS.items()])).alias("d")
    items = docs.select("name", "text", details).select("name", "d.detail", F.substring("text", F.lit(1), F.col("d.cap")).alias("text"))
    said = F.concat_ws(" and ", "name", "next")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("detail"), F.lit(1 if k == "names" else 2).alias("times")) for k in ("names", *_CUTS)])).alias("k")
    pairs = docs.where("next is not null").select(F.col("name").alias("src"), F.col("next").alias("dst"), said.alias("said"), kinds).select("src", "dst", "k.detail", F.repeat("said", F.col("k.times")).alias("text"))
    topic = F.slice(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("tion"))), 1, 2)
    extras = docs.select("name", F.posexplode(topic).alias("line", "text")).select("name", F.lit("topic").alias("kind"), "line", "text")
    size = lambda rows: rows.withColumn("size", F.length("text").cast("long")).drop("text")
    return stories.plan(cast, size(items), size(pairs), size(extras).select("name", "size")), items, pairs, extras


@query(f"""with {_PLAN_SQL}
  select o.pack, b.tier, case when b.rank in (8, 9) then 'names' else (select max(p) from (values {", ".join(f"({n}, '{p}')" for n, (_, p) in enumerate(packs.TIERS, 1))}) as t(n, p) where n = b.rank) end as pair_detail,
    o.name, o.place, list_value({", ".join(f"'{k}'" for k in _CUTS)})[coalesce(r.levels[o.place], b.item)] as detail
  from own o join begun b using (pack) left join rec r using (pack)""")
def story_plan(spark, d):
    """Each source's documents as a cast, neighbours as pairs, lines of a topic beside them; what is left raises the first members."""
    return _story_plan(spark, d)[0].select("pack", "tier", "pair_detail", "name", F.col("place").cast("long").alias("place"), "detail")


@query(f"""with {_PLAN_SQL},
  told as (select o.pack, 0 as a, o.place as b, 0 as c, 0 as e, left(m.text, list_value({", ".join(map(str, _CUTS.values()))})[coalesce(r.levels[o.place], b.item)]) as text
      from own o join members m using (pack, name) join begun b using (pack) left join rec r using (pack)
    union all select pack, 0, place, 1, unnest(range(len(ls))), unnest(ls) from (select pack, place, list_filter(string_split(text, chr(10)), lambda x: contains(x, 'tion'))[1:2] as ls from members)
    union all select a.pack, 1, a.place, b.place, 0, repeat(a.name || ' and ' || b.name, case when g.rank in (8, 9) then 1 else 2 end) from members a join members b on a.pack = b.pack and b.place = a.place + 1 join begun g on g.pack = a.pack)
  select pack, count(*) as n_texts, sum(length(text))::bigint as size, sha256(string_agg(text, chr(10) order by a, b, c, e)) as digest, true as within from told group by pack""")
def story_texts(spark, d):
    """The texts of the plans, each in one detail; packs keep to their limits where a tier fits, and parts give them again."""
    planned, items, pairs, extras = _story_plan(spark, d)
    written = stories.write(planned, items, pairs, extras)
    bodies = F.array_sort(F.collect_list(F.struct("part", "body", "parts")))
    parts = stories.framed_parts(stories.joined(written), "pack").groupBy("pack").agg(bodies.alias("b"), F.max(F.length("body")).alias("longest"))
    again = parts.select("pack", F.sha2(F.array_join(F.transform("b", lambda x: x["body"]), "\n"), 256).alias("digest"))
    counted = written.groupBy("pack").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("size"))
    limits = planned.groupBy("pack").agg(F.max("limit").alias("limit"), F.max("tier").alias("tier"), F.max("size").alias("planned"))
    return counted.join(again, "pack").join(limits, "pack").select("pack", "n_texts", "size", "digest", ((F.col("planned") == F.col("size")) & ((F.col("tier") == 99) | (F.col("size") <= F.col("limit")))).alias("within"))


@query("""with a as (select page_id, html from pages), r as (select n_nationkey::bigint as qid, n_name as query, case when n_nationkey % 3 = 0 then 'ambiguous' when n_nationkey % 3 = 1 then 'ok' else 'no_card' end as status from nation)
  select qid, query, status, case when status = 'ok' then 2::bigint end as line, case when status = 'ok' then 'born ' || query end as text from r""")
def show_section(spark, d):
    """A section of each nation's card; some names mean several, some have no card."""
    n = F.col("n_nationkey")
    nation = table(spark, d, "nation")
    resolved = nation.select(n.cast("long").alias("qid"), F.col("n_name").alias("query"), F.when(n % 3 == 0, "ambiguous").otherwise("ok").alias("status"), F.array("n_name").alias("slugs"))
    html = F.concat(F.lit("<article><h2>Life</h2>born "), F.col("n_name"), F.lit("<h2>Lifework</h2>x</article>"))
    cards = articles.parse_pages(nation.where("n_nationkey % 3 < 2").select(F.col("n_name").alias("slug"), F.lit("http://h/").alias("url"), html.alias("html")), "slug")
    shown = commands.show(resolved, cards.select("slug", "article"), ["Life"])
    return shown.where("line is null or line = 2").select("qid", "query", "status", "line", "text")
