"""URL functions: identity, scope, host, joining."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SLUG = "[A-Za-z0-9_-]{1,128}"
ENCODINGS = ("euc_jp", "euc_jis_2004")  # of titles in addresses
UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
URL_IN_TEXT = r"(?i)(?:https?:)?//[^\s<>\"'`\\|\]\[)(]+"


def identity(url: Column) -> Column:
    """Without fragment, with the hex digits of escapes in upper case."""
    parts = F.split(F.split_part(url, F.lit("#"), F.lit(1)), "%")
    upper = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30))).otherwise(p),
    )
    return F.array_join(F.concat(F.slice(parts, 1, 1), upper), "%")


def article_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))


@F.pandas_udf(T.StringType())
def article_identity(urls: pd.Series) -> pd.Series:
    """``article_url`` with escapes of unreserved characters decoded."""

    def decode(m: re.Match) -> str:
        byte = unquote_to_bytes(m[0])
        return byte.decode() if byte[0] in UNRESERVED else m[0].upper()

    return urls.map(lambda u: re.sub("%[0-9A-Fa-f]{2}", decode, re.split("[#?]", u)[0]), na_action="ignore")


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` joined to ``base``; null if it cannot be."""

    def join(b: str, h: str) -> str | None:
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([join(b, h) if b is not None and h is not None else None for b, h in zip(base, href, strict=True)], dtype=object)


def host(url: Column) -> Column:
    """Lower case, without user, port and closing dots; null if there is none."""
    clean = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")
    found = F.regexp_extract(clean, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/?#\s]*@)?(\[[^\]]*\]|[^:/?#\s]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"\.+$", "")), F.lit(""))


def parents(host_name: Column) -> Column:
    """The host and every parent domain, the most specific first."""
    labels = F.split(host_name, r"\.")
    n = F.size(labels)
    return F.when(host_name.isNotNull(), F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def scope_error(url: Column, allowed_host: str, slug: str) -> Column:
    """Null for a URL of the wiki's root or an article below /d/, else why not."""
    path = F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1)
    return (
        F.when(url.isNull() | url.rlike(r"[\x00-\x20\x7f]"), "invalid_url")
        .when(url.contains("�"), "corrupted_url")
        .when(url.rlike("%(?![0-9A-Fa-f]{2})"), "invalid_url")
        .when(~F.startswith(url, F.lit("https://")), "url_out_of_scope")
        .when(~F.coalesce(host(url) == allowed_host, F.lit(False)), "url_out_of_scope")
        .when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), "url_out_of_scope")
        .when(~path.rlike(f"^/{re.escape(slug)}/?(?:d/.*)?$"), "url_out_of_scope")
    )


def wiki_slug(url: Column) -> Column:
    """The first step of a URL's path, if it is a slug; null otherwise."""
    return F.nullif(F.regexp_extract(url, rf"^https?://[^/?#]+/({SLUG})(?:[/?#]|$)", 1), F.lit(""))


def wiki_base(url: Column) -> Column:
    """Scheme, host and slug of a URL, with a slash at the end; null without a slug."""
    return F.concat(F.nullif(F.regexp_extract(url, rf"^(https?://[^/?#]+/{SLUG})(?:[/?#]|$)", 1), F.lit("")), F.lit("/"))


def page_title(url: str | None) -> str | None:
    """The title in an article's address (below /slug/d/); null if it is none or not in the expected encodings."""
    m = re.match(rf"https?://[^/?#]+/{SLUG}/d/([^?#]+)", url or "")
    for name in ENCODINGS:
        try:
            return unquote_to_bytes(m[1]).decode(name) if m else None
        except UnicodeError:
            pass
    return None


@F.pandas_udf(T.StringType())
def article_title(urls: pd.Series) -> pd.Series:
    return urls.map(page_title, na_action="ignore")


def slug_is_valid(slug: Column, keyword: str = "") -> Column:
    return slug.rlike(f"^{SLUG}$") & F.contains(F.lower(slug), F.lit(keyword))


def urls_in(text: Column) -> Column:
    """Distinct URLs of a text, also where tabs or line ends cut them."""
    find = lambda t: F.regexp_extract_all(t, F.lit(URL_IN_TEXT), 0)
    both = F.array_union(find(text), find(F.regexp_replace(text, r"[\t\r\n]", "")))
    return F.array_distinct(F.transform(both, lambda u: F.regexp_replace(u, r"[,;.]+$", "")))


def query_value(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&#]*)", 1), F.lit(""))


def escape_pointer(key: Column) -> Column:
    """A key as a step of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
