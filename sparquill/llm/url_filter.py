"""URL filters: host/path rules first, then pattern rules found by their rarest token.

Every pattern rule names literal tokens that each URL it matches must hold.
The operator counts, over all URLs, how many hold each of those tokens and
files every rule under its rarest one.  A URL's own tokens then fetch the few
candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, once

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is matched against the URL with A-Z lower-cased; each URL it
    matches holds all of ``literals`` as whole [a-z0-9]+ tokens."""

    name: str
    pattern: str
    literals: tuple[str, ...]
    verdict: str = "block"


# The rules that the query applies.
HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)

# What no host rule decides.  Path steps of forms, accounts, shops, traps and
# machine files; parameters of sessions, replies, sharing and printing; words of hosts; files.
PATH_STEPS = (
    "login", "logout", "signin", "signup", "register", "cart", "basket", "checkout", "wp-admin", "wp-json", "wp-login.php", "xmlrpc.php",
    "cgi-bin", "admin", "search", "feed", "rss", "trackback", "print", "comment-page-1", "lost-password", "privacy-policy", "cookie-policy",
    "terms-of-service", "unsubscribe", "captcha",
)
PARAMETERS = ("sessionid", "phpsessid", "jsessionid", "sid", "replytocom", "share", "print", "add-to-cart", "utm_redirect", "redirect_to", "captcha")
HOST_WORDS = ("casino", "poker", "porn", "xxx", "escort", "viagra", "adserver", "doubleclick", "tracker")
FILE_ENDS = ("exe", "zip", "rar", "dmg", "apk", "iso", "jpg", "jpeg", "png", "gif", "mp3", "mp4", "css", "js")


def literals_of(text: str) -> tuple[str, ...]:
    """The tokens of a literal text, which stand whole in a URL as the pattern guards both ends."""
    return tuple(dict.fromkeys(TOKEN.findall(text)))


PATTERN_RULES = (
    *(PatternRule(f"step {s}", rf"/{re.escape(s)}(?:[/?#]|$)", literals_of(s)) for s in PATH_STEPS),
    *(PatternRule(f"parameter {p}", rf"[?&;]{re.escape(p)}=", literals_of(p)) for p in PARAMETERS),
    *(PatternRule(f"host {w}", rf"://(?:[^/?#]*[^a-z0-9/?#])?{w}(?:[^a-z0-9]|$)", (w,)) for w in HOST_WORDS),
    *(PatternRule(f"file {e}", rf"\.{e}(?:[?#]|$)", (e,)) for e in FILE_ENDS),
    PatternRule("calendar", r"/calendar/[0-9]{4}/[0-9]{2}(?:[/?#]|$)", ("calendar",)),
)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule_column(host: Column, path: Column, rules: tuple[HostRule, ...], field: str) -> Column:
    """Name or verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def literal_frequencies(urls: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """How many URLs hold each literal of the rules; as many entries as literals."""
    literals = sorted({t for r in rules for t in r.literals})
    tokens = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("url")), F.lit("[a-z0-9]+"), 0))
    counted = (
        urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, literals)))).alias("token"))
        .groupBy("token")
        .count()
        .collect()
    )
    return {t: 0 for t in literals} | {r["token"]: r["count"] for r in counted}


def rule_index(rules: tuple[PatternRule, ...], frequency: dict[str, int]) -> dict[str, list[PatternRule]]:
    index: dict[str, list[PatternRule]] = {}
    for rule in rules:
        rarest = min(rule.literals, key=lambda t: (frequency.get(t, 0), t))
        index.setdefault(rarest, []).append(rule)
    return index


def pattern_verdict(index: dict[str, list[PatternRule]], order: dict[str, int]):
    """A function of URL columns: the first fitting rule's name, by list order, or null."""
    compiled = {t: [(order[r.name], re.compile(r.pattern), r.name) for r in rs] for t, rs in index.items()}
    ascii_lower = {c: c + 32 for c in range(65, 91)}

    @once
    @F.pandas_udf(T.StringType())
    def matched(urls: pd.Series) -> pd.Series:
        out = []
        for url in urls:
            if url is None:
                out.append(None)
                continue
            low = url.translate(ascii_lower)
            fetched = [r for t in set(TOKEN.findall(low)) if t in compiled for r in compiled[t]]
            hits = [r for r in fetched if r[1].search(low)]
            out.append(min(hits)[2] if hits else None)
        return pd.Series(out, dtype=object)

    return matched


def filter_urls(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """page_id, url, host, path, rule, pattern, verdict for each row of ``pages``.

    Null URLs and URLs without ``://`` have an empty host and path and fit no host
    rule; null ones are allowed, the others are allowed unless a pattern rule finds
    its pattern in the whole text.  Repeated rows are judged alike, URLs of any length are read
    whole, an empty table gives an empty table, and other columns are ignored.
    """
    index = rule_index(pattern_rules, literal_frequencies(pages, pattern_rules))
    matched = pattern_verdict(index, {r.name: i for i, r in enumerate(pattern_rules)})
    verdicts = F.lit(None).cast("string")
    for rule in pattern_rules:
        verdicts = F.when(F.col("pattern") == rule.name, F.lit(rule.verdict)).otherwise(verdicts)
    host, path = F.col("host"), F.col("path")
    return (
        pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("rule", host_rule_column(host, path, host_rules, "name"))
        .withColumn("rule_verdict", host_rule_column(host, path, host_rules, "verdict"))
        .withColumn("pattern", matched("url"))
        .select("page_id", "url", "host", "path", "rule", "pattern",
                F.coalesce("rule_verdict", verdicts, F.lit("allow")).alias("verdict"))
    )


def oracle() -> str:
    """DuckDB: the same verdicts by running every pattern on every URL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    longest = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    fits = [f"((host = '{r.host}' or suffix(host, '.{r.host}')) and starts_with(path, '{r.path}'))" for r in longest]
    rule = " ".join(f"when {f} then '{r.name}'" for f, r in zip(fits, longest, strict=True))
    verdict = " ".join(f"when {f} then '{r.verdict}'" for f, r in zip(fits, longest, strict=True))
    patterns = " ".join(f"when regexp_matches(low, '{r.pattern}') then '{r.verdict}'" for r in PATTERN_RULES)
    return f"""
    with parts as (
      select page_id, url, translate(coalesce(url, ''), '{upper}', '{lower}') as low,
             coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') as host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
      from pages)
    select page_id, host, path, case {rule} end as rule,
           case {verdict} {patterns} else 'allow' end as verdict
    from parts"""
