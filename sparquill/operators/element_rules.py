"""Why a page element is skipped: one set of rules for parsers and for rows.

Every attribute of an element may give findings; the one of the first rank
counts.  An element that is, or holds, the article gives none, whatever else it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from sparquill.operators import rules

RANKS = ("ad_class", "ad_id", "ad_id_prefix", "ad_attribute", "ad_host", "chrome_id", "chrome_class")
_HOST = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/?#\s]*@)?(\[[^\]]*\]|[^:/?#\s]+)")


class ElementRules:
    def __init__(self, ad_hosts: Iterable[str] = tuple(rules.HOSTS["ad"]), ad_classes: Iterable[str] = ()):
        """``ad_classes`` are skipped beside those of the rule tables."""
        self.hosts = frozenset(ad_hosts)
        self.classes = {c: "chrome_class" for c in rules.CHROME_CLASSES} | {c: "ad_class" for c in (*rules.AD_CLASSES, *ad_classes)}
        self.ids = {i: "chrome_id" for i in rules.CHROME_IDS} | {i: "ad_id" for i in rules.AD_IDS}
        self.host_rule = lru_cache(4096)(self._host_rule)

    def __reduce__(self):
        return _with_classes, (tuple(self.hosts), tuple(c for c, k in self.classes.items() if k == "ad_class"))

    def _host_rule(self, host: str) -> str | None:
        """The most specific rule that covers a host."""
        labels = host.lower().rstrip(".").split(".")
        return next((r for i in range(len(labels)) if (r := ".".join(labels[i:])) in self.hosts), None)

    def address_rule(self, attribute: str, value: str) -> str | None:
        """The rule of the first ad host in a URL attribute; only a srcset lists several URLs."""
        found = (_HOST.match(part) for part in (value.split(",") if "srcset" in attribute else (value,)))
        return next((r for m in found if m and (r := self.host_rule(m[1]))), None)

    def judge(self, attributes: Iterable[tuple[str, str | None]]) -> str | None:
        """kind/reason:detail of an element, null if it stays; ``attributes`` in page order."""
        findings = []
        for place, (name, value) in enumerate(attributes):
            if name == "class" and value:
                tokens = value.split()
                if not rules.ARTICLE_CLASS_SET.isdisjoint(tokens):
                    return None
                findings += [(RANKS.index(self.classes[t]), t, t) for t in tokens if t in self.classes]
            elif name == "id" and value:
                if value in rules.ARTICLE_IDS:
                    return None
                reason = self.ids.get(value) or ("ad_id_prefix" if value.startswith(rules.AD_ID_PREFIXES) else None)
                if reason:
                    findings.append((RANKS.index(reason), "", value))
            elif name in rules.AD_DATA:
                findings.append((RANKS.index("ad_attribute"), f"{place:06d}", name))
            elif value and name in rules.URL_ATTRIBUTES and "//" in value and (rule := self.address_rule(name, value)):
                findings.append((RANKS.index("ad_host"), f"{place:06d}", rule))
        if not findings:
            return None
        rank, _, detail = min(findings)
        return f"{RANKS[rank].partition('_')[0]}/{RANKS[rank]}:{detail}"


def _with_classes(hosts: tuple[str, ...], classes: tuple[str, ...]) -> ElementRules:
    return ElementRules(hosts, classes)


SHIPPED = ElementRules()
