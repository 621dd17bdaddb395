"""Story packs: what is told of a cast within a budget, planned by sizes alone.

A plan needs the sizes of texts, not the texts: it sums them up by detail, takes
the first tier that fits, and spends what is left on single members.  Only then
are texts read, each in the one detail that its pack gives it, so that no text
is copied for tiers that are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators import lines, packs

#: Details of items, the smallest first.
DETAILS = ("cameo", "brief", "normal", "full", "ace")
# Fixed value: characters of a part in which a long pack is read.
PART = 15_000


def _limits(cast: DataFrame) -> DataFrame:
    return cast.groupBy("pack").agg(F.coalesce(F.max("limit"), packs.automatic_budget(F.count(F.lit(1)))).cast("long").alias("limit"), F.count(F.lit(1)).alias("members"))


def in_pack(cast: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, dst and more) of two members of a pack: pack, p and q, their places."""
    src = cast.select("pack", F.col("name").alias("src"), F.col("place").alias("p"))
    dst = cast.select("pack", F.col("name").alias("dst"), F.col("place").alias("q"))
    return pairs.join(src, "src").join(dst, ["pack", "dst"])


def plan(cast: DataFrame, sizes: DataFrame, pair_sizes: DataFrame, extras: DataFrame | None = None, ceiling: str | None = None,
         tiers: tuple = packs.TIERS, upgrades: bool = True) -> DataFrame:
    """pack, limit, tier, pair_detail, size, name, place and detail of each member.

    ``cast``: pack, name, place and limit (null: the automatic budget); ``sizes``:
    name, detail, size; ``pair_sizes``: src, dst, detail, size, for pairs of members
    in either direction; ``extras``: name, size of what a member brings in every
    tier (topics, reactions).  ``ceiling`` is the fullest detail that may be taken,
    of items and of pairs.  The first tier that fits is taken, 99 if none does, with
    the details of the smallest.  What is left raises members by one detail
    each in the order of the cast, all once before any twice; what a member has no
    text for counts as empty.  A member without any text stays in the plan.
    """
    top = len(DETAILS) if ceiling is None else DETAILS.index(ceiling) + 1
    above = set(DETAILS[top:])
    tiers = tuple((n, item, pair) for n, (item, pair) in enumerate(tiers, 1) if item not in above and pair not in above)
    limits = _limits(cast)
    members = cast.select("pack", "name", "place")
    # one row for each member: the sizes of all its details, in order
    held = sizes.groupBy("name").agg(F.array(*[F.coalesce(F.max(F.when(F.col("detail") == d, F.col("size"))), F.lit(0)).cast("long") for d in DETAILS[:top]]).alias("sizes"))
    extra = (extras or sizes.limit(0).select("name", "size")).groupBy("name").agg(F.sum("size").cast("long").alias("extra"))
    nothing = F.array(*[F.lit(0).cast("long")] * top)
    own = members.join(held, "name", "left").join(extra, "name", "left").select("pack", "name", "place", F.coalesce("sizes", nothing).alias("sizes"), F.coalesce("extra", F.lit(0).cast("long")).alias("extra"))
    of_items = own.groupBy("pack").agg(*[F.sum(F.element_at("sizes", i)).alias(f"item_{d}") for i, d in enumerate(DETAILS[:top], 1)], F.sum("extra").alias("extra"))
    kinds = sorted({pair for _, _, pair in tiers})
    of_pairs = in_pack(cast, pair_sizes.where(F.col("detail").isin(*kinds))).groupBy("pack").agg(*[F.sum(F.when(F.col("detail") == k, F.col("size"))).cast("long").alias(f"pair_{k}") for k in kinds])
    pack = limits.join(of_items, "pack").join(of_pairs, "pack", "left")
    zero = F.lit(0).cast("long")
    pair_size = lambda k: F.coalesce(F.col(f"pair_{k}"), zero)
    sized = [
        F.struct(F.lit(n).cast("long").alias("rank"), (F.col(f"item_{item}") + pair_size(pair) + F.col("extra")).alias("size"), F.lit(item).alias("item"), F.lit(pair).alias("pair"), pair_size(pair).alias("pair_size"))
        for n, item, pair in tiers
    ]
    fits = F.try_element_at(F.filter(F.array(*sized), lambda t: t["size"] <= F.col("limit")), F.lit(1))
    least = F.array_min(F.transform(F.array(*sized), lambda t: F.struct(t["size"], t["rank"], t["item"], t["pair"], t["pair_size"])))
    chosen = pack.select("pack", "limit", fits.alias("fits"), least.alias("least")).select(
        "pack", "limit", F.coalesce("fits.rank", F.lit(99).cast("long")).alias("tier"), *[F.coalesce(f"fits.{c}", f"least.{c}").alias(c) for c in ("item", "pair", "pair_size", "size")])
    level = F.array_position(F.array(*map(F.lit, DETAILS)), F.col("item")).cast("long") - 1
    taken = own.join(chosen, "pack").withColumn("level", level)
    if upgrades:
        spend = taken.select("pack", F.col("place").alias("ord"), F.col("name").alias("item"), "level", "sizes", (F.col("limit") - F.col("pair_size") - F.sum("extra").over(Window.partitionBy("pack"))).alias("limit"))
        raised = packs.upgrade(spend.where("limit is not null"), "pack").select("pack", F.col("item").alias("name"), F.col("level").alias("raised"))
        taken = taken.join(raised, ["pack", "name"]).withColumn("level", F.when(F.col("tier") == 99, F.col("level")).otherwise(F.col("raised")))
    size = F.col("pair_size") + F.sum(F.element_at("sizes", (F.col("level") + 1).cast("int")) + F.col("extra")).over(Window.partitionBy("pack"))
    return taken.select("pack", "limit", "tier", F.col("pair").alias("pair_detail"), size.alias("size"), "name", "place", F.element_at(F.array(*map(F.lit, DETAILS)), (F.col("level") + 1).cast("int")).alias("detail"))


def write(planned: DataFrame, items: DataFrame, pairs: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """pack, place, kind, name, other, detail and text of a plan, in reading order:
    each member's item and what it brings beside it, then the pairs.

    ``items``: name, detail, text; ``pairs``: src, dst, detail, text; ``extras``: name,
    kind, line, text.  Texts meet the plan by name and detail, once each."""
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    told = planned.join(items, ["name", "detail"]).select("pack", F.struct(zero.alias("a"), F.col("place").cast("long").alias("b"), zero.alias("c"), F.lit("").alias("d"), zero.alias("e")).alias("at"),
                                                         F.lit("item").alias("kind"), "name", none.alias("other"), "detail", "text")
    if extras is not None:
        beside = planned.join(extras, "name").select(
            "pack", F.struct(zero.alias("a"), F.col("place").cast("long").alias("b"), F.lit(1).cast("long").alias("c"), F.col("kind").alias("d"), F.col("line").cast("long").alias("e")).alias("at"), "kind", "name", none.alias("other"), none.alias("detail"), "text")
        told = told.unionByName(beside)
    wanted = planned.select("pack", "pair_detail").distinct()
    both = in_pack(planned, pairs).join(wanted, "pack").where(F.col("detail") == F.col("pair_detail")).select(
        "pack", F.struct(F.lit(1).cast("long").alias("a"), F.col("p").cast("long").alias("b"), F.col("q").cast("long").alias("c"), F.lit("").alias("d"), zero.alias("e")).alias("at"),
        F.lit("pair").alias("kind"), F.col("src").alias("name"), F.col("dst").alias("other"), "detail", "text")
    order = Window.partitionBy("pack").orderBy("at")
    return told.unionByName(both).select("pack", F.row_number().over(order).cast("long").alias("place"), "kind", "name", "other", "detail", "text")


def view(planned: DataFrame) -> DataFrame:
    """pack and text: the details that a plan gives, one member a line, then the pairs and the size."""
    number = lambda c: F.col(c).cast("string")
    rows = planned.groupBy("pack", "limit", "tier", "pair_detail", "size").agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("detail")).alias("said")))).alias("rows"), F.count(F.lit(1)).alias("n"))
    pairs = F.concat(F.lit("pairs ("), (F.col("n") * (F.col("n") - 1) / 2).cast("long").cast("string"), F.lit("): "), F.col("pair_detail"))
    size = F.concat(F.lit("characters: "), number("size"), F.lit(" of "), number("limit"))
    return rows.select("pack", F.concat_ws("\n", F.array_join(F.transform("rows", lambda r: r["said"]), "\n"), pairs, size).alias("text"))


def framed_parts(texts: DataFrame, key: str, limit: int = PART, text: str = "text") -> DataFrame:
    """key, part, parts, header, body and footer: ``lines.parts`` with what stands
    around each part; bodies joined by line feeds give the text again."""
    cut = texts.select(key, lines.cut_column(text, limit).alias("_bodies"))
    n = F.size("_bodies").cast("string")
    said = lambda what, i: F.concat(F.lit(f"part "), (i + 1).cast("string"), F.lit(" of "), n, F.lit(what))
    rows = F.transform("_bodies", lambda b, i: F.struct(
        (i + 1).cast("long").alias("part"), F.size("_bodies").cast("long").alias("parts"), said(":", i).alias("header"), b.alias("body"),
        F.when(i + 1 < F.size("_bodies"), F.concat(said(" ends here; part ", i), (i + 2).cast("string"), F.lit(" follows"))).otherwise(said(" ends here; it is the last", i)).alias("footer")))
    return cut.select(key, F.inline(rows))


def joined(written: DataFrame) -> DataFrame:
    """pack and text: what ``write`` gives as one text, in order."""
    rows = F.array_sort(F.collect_list(F.struct("place", "text")))
    return written.groupBy("pack").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
