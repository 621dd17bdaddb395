"""Material packs: casts, topics, co-mentions, detail tiers under a budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators import patterns

# Tiers of (item detail, pair detail), the fullest first.
TIERS = (
    ("ace", "ace"), ("full", "full"), ("full", "normal"), ("full", "brief"), ("normal", "normal"),
    ("normal", "brief"), ("brief", "brief"), ("brief", "names"), ("cameo", "names"),
)
BUDGET_FIRST, BUDGET_MORE, BUDGET_MOST = 120_000, 15_000, 300_000
#: Items of a pack whose sizes are Python's at once.
TOGETHER = 4096


def automatic_budget(n: Column) -> Column:
    """Characters for a pack of n entities."""
    return F.least(F.lit(BUDGET_FIRST) + F.lit(BUDGET_MORE) * (n - 1), F.lit(BUDGET_MOST)).cast("long")


def first_fitting_tier(sizes: DataFrame, key: str) -> DataFrame:
    """key, tier, size: the first tier (by rank) that the limit allows; tier 99
    with the smallest size where none does.  ``sizes``: key, rank, size, limit."""
    fits = F.col("size") <= F.col("limit")
    return sizes.groupBy(key).agg(
        F.coalesce(F.min(F.when(fits, F.col("rank"))), F.lit(99)).cast("long").alias("tier"),
        F.coalesce(F.min_by("size", F.when(fits, F.col("rank"))), F.min("size")).cast("long").alias("size"),
    )


def upgrade(items: DataFrame, key: str) -> DataFrame:
    """key, item, level: spend what a budget leaves on raising items.

    ``items``: key, ord, item, level, limit (of the pack) and sizes, an array of
    the item's size at every level, the smallest first.  Items are raised by one
    level in order of ord, all once before any twice; what does not fit is
    skipped.  Each step depends on what is left, so a pack is worked off in one
    group, as whole arrays: about a hundred bytes an item.
    """

    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def spend(pack: pa.Table) -> pa.Table:
        pack = pack.take(pc.sort_indices(pack.column("ord"))).combine_chunks()
        level, sizes = pack.column("level").to_numpy().astype(np.int64), pack.column("sizes").combine_chunks()
        ends = np.cumsum(pc.list_value_length(sizes).to_numpy(zero_copy_only=False))
        at, sizes = np.concatenate([[0], ends[:-1]]).astype(np.int64) + level, sizes.flatten().to_numpy(zero_copy_only=False)
        blocks = [slice(i, i + TOGETHER) for i in range(0, len(at), TOGETHER)]
        left = pack.column("limit")[0].as_py() - sum(sum(sizes[at[block]].tolist()) for block in blocks)
        raised = True
        while raised:
            raised = False
            for block in blocks:  # numbers of a few items at once are Python's
                open_ = block.start + np.flatnonzero(at[block] + 1 < ends[block])
                costs = (sizes[at[open_] + 1] - sizes[at[open_]]).tolist()
                for i, cost in zip(open_.tolist(), costs, strict=True):
                    if cost <= left:
                        left -= cost
                        at[i] += 1
                        level[i] += 1
                        raised = True
        return pa.table({key: pack.column(key), "item": pack.column("item"), "level": pa.array(level)})

    return items.select(key, "ord", "item", "level", "limit", "sizes").groupBy(key).applyInArrow(spend, f"`{key}` {kinds[key]}, item {kinds['item']}, level long")


def cast(roster: DataFrame, named: DataFrame, groups: list[str], excluded: DataFrame | None = None, include_former: bool = False) -> DataFrame:
    """name and place: the named members first, then the groups' in roster order.

    ``roster``: name, grp, ord, former; ``named``: name, ord.  Nobody comes twice.
    """
    members = roster.where(F.col("grp").isin(*groups))
    if not include_former:
        members = members.where(~F.col("former"))
    rest = members.join(named, "name", "left_anti").select("name", F.lit(1).alias("source"), F.col("former").cast("int").alias("late"), "ord")
    both = named.select("name", F.lit(0).alias("source"), F.lit(0).alias("late"), "ord").unionByName(rest)
    if excluded is not None:
        both = both.join(excluded, "name", "left_anti")
    return both.select("name", F.row_number().over(Window.orderBy("source", "late", "ord")).cast("long").alias("place"))


def topic(lines: DataFrame, phrase: str, cap: int, key: str) -> DataFrame:
    """Lines with the phrase; where it occurs nowhere and has spaces, lines with
    any of its words; at most ``cap`` per document."""
    if not phrase.strip():
        raise ValueError("the topic is blank")
    parts = phrase.split()
    whole = F.contains("text", F.lit(phrase))
    some = F.lit(False)
    for p in parts:
        some = some | F.contains("text", F.lit(p))
    candidates = lines.where(whole | some).withColumn("whole", whole)
    seen = candidates.agg(F.coalesce(F.max("whole"), F.lit(False)).alias("seen"))
    kept = candidates.join(F.broadcast(seen), F.col("whole") | ~F.col("seen")).drop("seen")
    order = Window.partitionBy(key).orderBy("line")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select(key, "line", "text", F.when(F.col("whole"), "phrase").otherwise("words").alias("matched"))


def co_mentions(lines: DataFrame, names: list[str] | DataFrame, key: str) -> DataFrame:
    """key, line, name: lines that hold a name as a word of its own.

    A few names are looked for by Spark's own functions, a table of them (name) by
    one automaton (see ``patterns``), in one pass over the lines."""
    if isinstance(names, DataFrame):
        found = patterns.occurrences(lines.select(key, "line", "text"), names.select(F.col("name").alias("pattern")), whole_words=True, with_text=False)
        return found.select(key, "line", F.col("pattern").alias("name"))
    hits = [F.when(F.contains("text", F.lit(n)) & F.col("text").rlike(rf"(?<![A-Za-z0-9_])\Q{n}\E(?![A-Za-z0-9_])"), F.lit(n)) for n in names]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")
    return lines.select(key, "line", F.explode(found).alias("name"))


def first_filled(sections: DataFrame, key: str, priorities: list[str]) -> DataFrame:
    """key, heading, text, fallback: the first of the headings that is not empty."""
    ranks = F.array_position(F.array(*map(F.lit, priorities)), F.col("heading"))
    filled = sections.where(F.col("heading").isin(*priorities) & (F.trim("text") != "")).withColumn("rank", ranks)
    best = filled.groupBy(key).agg(F.min_by(F.struct("heading", "text", "rank"), "rank").alias("s"))
    return best.select(key, "s.heading", "s.text", (F.col("s.rank") > 1).alias("fallback"))


def reactions(lines: DataFrame, kinds: dict[str, list[str]] | DataFrame, key: str, per_kind: int = 8, most: int = 48) -> DataFrame:
    """key, kind, line, text: lines with a keyword of a kind, in order, capped per
    kind and document.  ``kinds``: keywords by kind, or a table of them (kind, pattern),
    which one automaton looks for."""
    if isinstance(kinds, DataFrame):
        found = patterns.occurrences(lines.select(key, "line", "text"), kinds)
        rows = found.join(kinds.select("kind", "pattern").distinct(), "pattern").select(key, "line", "text", "kind").distinct()
    else:
        tagged = F.filter(
            F.array(*[F.when(F.greatest(*[F.contains("text", F.lit(w)) for w in [ws[0], *ws]]), F.lit(k)) for k, ws in kinds.items()]), lambda x: x.isNotNull()
        )
        rows = lines.select(key, "line", "text", F.explode(tagged).alias("kind"))
    inside = Window.partitionBy(key, "kind").orderBy("line")
    overall = Window.partitionBy(key).orderBy("kind", "line")
    kept = rows.withColumn("n", F.row_number().over(inside)).where(F.col("n") <= per_kind).drop("n")
    return kept.withColumn("n", F.row_number().over(overall)).where(F.col("n") <= most).select(key, "kind", "line", "text")
