"""Who calls whom what, and which entity a name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions.text import GENERIC_WORDS, ROLE_TITLES, closeness, fold_text

STRONG_KINDS = ("name", "slug", "alias", "reading", "handle")
# Shortest and longest key of a nickname; rows that support a role's title.
KEY_LENGTHS, ROLE_SUPPORT = (2, 24), 3
#: Characters of the pieces by which names are found that hold a query, and names that one task meets of a frequent piece.
PIECE, HOT = 3, 4096


def mutual(edges: DataFrame) -> DataFrame:
    """src, dst and whether the reverse edge exists; one join on swapped keys."""
    one = edges.select("src", "dst").distinct()
    back = one.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(True).alias("back"))
    return one.join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce("back", F.lit(False)).alias("mutual"))


def reverse(edges: DataFrame, name: str) -> DataFrame:
    """What others call ``name``."""
    return edges.where(F.col("dst") == name)


def matrix(cast: DataFrame, edges: DataFrame) -> DataFrame:
    """Every ordered pair of two members of a cast (src, dst), with the label of
    their edge or a dash.  A cast is a handful of names, so the pairs are the
    result asked for."""
    everyone = F.sort_array(F.collect_set("name"))
    pairs = cast.agg(everyone.alias("all")).select(F.explode("all").alias("src"), "all").select("src", F.explode("all").alias("dst")).where("src <> dst")
    return pairs.join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("label", F.lit("-")).alias("label"))


def strong_keys(people: DataFrame, fold) -> DataFrame:
    """key, slug, kind, original of ``people``: slug, kind, original."""
    return people.where(F.col("kind").isin(*STRONG_KINDS)).select(fold(F.col("original")).alias("key"), "slug", "kind", "original").where("key <> ''")


def folded_words(words: list[str]) -> tuple[str, ...]:
    return tuple(sorted({fold_text(w) for w in words}))


#: Keys of words that mean no one in particular, and of those that a role may yet give to one person.
GENERIC, ROLES = folded_words(GENERIC_WORDS), folded_words(ROLE_TITLES)


def nickname_keys(nicknames: DataFrame, strong: DataFrame, fold, generic: tuple[str, ...] = GENERIC, role_titles: tuple[str, ...] = ROLES) -> DataFrame:
    """key, status (nickname or ambiguous), slugs, support.

    ``nicknames``: slug, original, one row for each naming record.  Keys that
    are too short or long, generic, strong already or without a letter or digit
    are left out; a role's title needs the support of several rows.
    """
    key = fold(F.col("original"))
    keyed = nicknames.select(key.alias("key"), "slug")
    role = F.col("key").isin(*role_titles) if role_titles else F.lit(False)
    fits = (F.length("key").between(*KEY_LENGTHS) | (role & (F.length("key") <= KEY_LENGTHS[1]))) & F.col("key").rlike(r"(?U)\w")
    if generic:
        fits = fits & (~F.col("key").isin(*generic) | role)
    counted = keyed.where(fits).join(strong.select("key").distinct(), "key", "left_anti").groupBy("key", "slug").agg(F.count(F.lit(1)).alias("n"))
    owners = counted.groupBy("key").agg(F.sort_array(F.collect_set("slug")).alias("slugs"), F.max("n").alias("support"))
    supported = owners.where(~role | (F.size("slugs") > 1) | (F.col("support") >= ROLE_SUPPORT))
    return supported.select("key", F.when(F.size("slugs") > 1, "ambiguous").otherwise("nickname").alias("status"), "slugs", "support")


def name_keys(strong: DataFrame, nicknames: DataFrame) -> DataFrame:
    """key, slug and kind: ``strong_keys``, and of ``nickname_keys`` both the
    nicknames and the ambiguous ones, which no weaker stage may override."""
    weak = nicknames.select("key", F.explode("slugs").alias("slug"), F.col("status").alias("kind"))
    return strong.select("key", "slug", "kind").unionByName(weak)


def prefix_hits(asked: DataFrame, words: DataFrame) -> DataFrame:
    """key and slug where a word begins with the key: words are filed under each of
    their beginnings, so the join is on equal keys and meets nothing else."""
    heads = F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring("word", F.lit(1), n))
    filed = words.where(F.length("word") > 0).select("word", "slug").distinct().select("slug", F.explode(heads).alias("key")).distinct()
    return asked.select("key").join(filed, "key")


def grams(text: Column) -> Column:
    """The distinct pieces of PIECE characters of a text, or the whole of a shorter one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - PIECE + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(PIECE))))


def part_pairs(asked: DataFrame, named: DataFrame, hot: int = HOT) -> DataFrame:
    """key, other, slug, piece and salt of the keys and names that share the key's
    rarest piece: the only names that can hold the key.

    Pieces are counted over all names first.  A piece of more than ``hot`` names is
    split by salt, and the keys that hang on it are sent to each of its parts."""
    filed = named.select("other", "slug").distinct().select("other", "slug", F.explode(pieces(F.col("other"))).alias("piece"))
    counts = filed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    wanted = asked.select("key", F.explode(grams(F.col("key"))).alias("piece")).join(counts, "piece", "left")
    rarest = wanted.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rare"))
    parts = F.ceil(F.col("rare.n") / hot).cast("int")
    rarest = rarest.where("rare.n > 0").select("key", F.col("rare.piece").alias("piece"), parts.alias("parts"))
    salted = filed.join(rarest.select("piece", "parts").distinct(), "piece").withColumn("salt", F.pmod(F.xxhash64("other", "slug"), F.col("parts")).cast("int"))
    asking = rarest.select("key", "piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return asking.join(salted.select("piece", "salt", "other", "slug"), ["piece", "salt"])


def resolve(queries: DataFrame, keys: DataFrame, words: DataFrame, generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """qid, query, stage, status and slugs for each of ``queries`` (qid, query, key).

    Stages: 1 a strong key, 2 a nickname or one that is known to be ambiguous, 3 the
    start of a word (from 3 characters, or 2 beyond ASCII), 4 a part of a name,
    alias or reading, which no generic word may be.  All are found at once; the
    lowest stage with a hit counts.  ``keys``: key, slug, kind (see ``name_keys``);
    ``words``: word, slug.

    Distinct keys are looked up once, however many queries ask for them, and every
    stage is a join on equal keys: beginnings of words, and rarest pieces of keys.
    """
    asked = queries.select("key").where(F.col("key") != "").distinct()
    exact = asked.join(keys, "key").select("key", "slug", F.when(F.col("kind").isin(*STRONG_KINDS), 1).otherwise(2).alias("stage"))
    least = F.when(F.col("key").rlike(r"^[\x00-\x7f]*$"), 3).otherwise(2)
    common = F.col("key").isin(*generic) if generic else F.lit(False)
    prefix = prefix_hits(asked.where(F.length("key") >= least), words).select("key", "slug", F.lit(3).alias("stage"))
    named = keys.where(F.col("kind").isin("name", "alias", "reading")).select(F.col("key").alias("other"), "slug")
    within = part_pairs(asked.where(~common), named).where(F.contains("other", F.col("key"))).select("key", "slug", F.lit(4).alias("stage"))
    best = exact.unionByName(prefix).unionByName(within).groupBy("key", "stage").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))
    chosen = best.groupBy("key").agg(F.min_by(F.struct("stage", "slugs"), "stage").alias("hit"))
    n = F.size("hit.slugs")
    missing = F.when(common, "generic").otherwise("not_found")
    return queries.join(chosen, "key", "left").select(
        "qid", "query", F.col("hit.stage").cast("long").alias("stage"),
        F.when(F.col("key") == "", "empty").when(F.col("hit").isNull(), missing).when(n > 1, "ambiguous").otherwise("ok").alias("status"),
        F.coalesce("hit.slugs", F.array().cast("array<string>")).alias("slugs"),
    )


def pieces(text: Column, most: int = PIECE) -> Column:
    """The distinct pieces of 1 to ``most`` characters of a text."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(F.length(text) >= n, of(n)).otherwise(none) for n in range(1, most + 1)]))


def numbered_letters(text: Column) -> Column:
    """The characters of a text with the number of their occurrence, as a set that
    stands for the multiset."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda d: d == c)).cast("string")))


def signatures(letters: Column, share: float) -> Column:
    """What two sets of letters have in common at least once, if each has ``share``
    of its letters in common with the other: pairs of the letters at the front, in
    an order that is one for all sets, of which two at least cannot be missing.
    Sets so small that one common letter may do give single letters as well."""
    size, need = F.size(letters), F.ceil(F.size(letters) * share - 1e-9).cast("int")
    front = F.slice(letters, F.lit(1), F.least(size, size - need + 2))
    pairs = F.flatten(F.transform(front, lambda a, i: F.transform(F.slice(front, i + 2, size), lambda b: F.concat_ws("\x01", a, b))))
    return F.when(need < 2, F.concat(pairs, letters)).otherwise(pairs)


def suggest(queries: DataFrame, keys: DataFrame, cutoff: float = 0.7, keys_most: int = 8, most: int = 5, similarity=closeness) -> DataFrame:
    """qid, slug, score: the owners of the closest keys of names that were not
    found (of two characters at least), from the ``keys_most`` closest keys
    ``most`` owners.

    A similarity of ``cutoff`` takes letters in common: cutoff / 2 of both lengths
    together, so cutoff / (2 - cutoff) of each.  Letters are ordered by the number
    of keys that hold them, the rarest first, and texts meet where the pairs at the
    front of both agree (see ``signatures``); pairs with too few letters in common
    never reach ``similarity``.  Distinct keys are looked up once.
    """
    asked = queries.where(F.length("key") >= 2).select(F.col("key").alias("word")).distinct()
    known = keys.select(F.col("key").alias("word")).where(F.length("word") > 0).distinct()
    letters = lambda rows: rows.select("word", F.explode(numbered_letters(F.col("word"))).alias("letter"))
    held = letters(known).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))

    def side(rows: DataFrame) -> DataFrame:
        ranked = letters(rows).join(held, "letter", "left")
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter")))
        sets = ranked.groupBy("word").agg(ordered.alias("ordered")).select("word", F.transform("ordered", lambda x: x["letter"]).alias("letters"))
        return sets.withColumn("signature", F.explode(signatures(F.col("letters"), cutoff / (2 - cutoff))))

    one = side(asked).select(F.col("word").alias("key"), "letters", "signature")
    other = side(known).select(F.col("word").alias("other"), F.col("letters").alias("other_letters"), "signature")
    pairs = one.join(other, "signature").drop("signature").distinct()
    shared = F.size(F.array_intersect("letters", "other_letters"))
    near = pairs.where(2 * shared >= cutoff * (F.size("letters") + F.size("other_letters")) - 1e-9)
    score: Column = similarity(F.col("key"), F.col("other"))
    scored = near.select("key", "other").withColumn("score", score).where(F.col("score") >= cutoff)
    by_key = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("other"))
    closest = scored.withColumn("place", F.row_number().over(by_key)).where(F.col("place") <= keys_most)
    owners = closest.join(keys.select(F.col("key").alias("other"), "slug").distinct(), "other")
    best = owners.groupBy("key", "slug").agg(F.max("score").alias("score"))
    near_owner = Window.partitionBy("key").orderBy(F.desc("score"), "slug")
    found = best.withColumn("place", F.row_number().over(near_owner)).where(F.col("place") <= most).drop("place")
    return queries.select("qid", "key").join(found, "key").select("qid", "slug", "score")
