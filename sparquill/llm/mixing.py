"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents form one stream of words, cut into blocks of a fixed
length.  How many of its slots each source fills is a multinomial draw of every
output shard: one source for each slot, by a hashed uniform number.  A source's
slots are numbered through all shards; those beyond its quota stay empty, and
what it lacks is drawn into shards behind the last, so that the sum meets its
target.  A pseudorandom permutation of its blocks (another one for each pass)
maps slot numbers to block numbers, and blocks join slots by that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_columns, Scratch, staged

WORD = r"[^\x20\x09-\x0D]+"

# Parameters of the mix.
WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # of all words
MAX_PASSES = 2  # over a source
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 20240607
#: Parts that a source's documents are dealt into for running totals, and shards in a run.
PARTS, RUN_SHARDS = 1024, 64
#: Equal ranges of [0, 1) under which the sources' shares are filed.
BINS = 4096
#: Slots of one task, up to so many tasks; beyond that tasks hold more, which they stream.
TASK_SLOTS, MOST_TASKS = 100_000, 20_000
ROUNDS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0..n-1: in each round x may swap places
    with its mirror image under a random reflection, by a random bit of the pair."""

    def swap(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*salt, r), n) - at, n)
        bit = F.xxhash64(*salt, r, F.greatest(at, mirror)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def uniform(*salt: Column) -> Column:
    """In [0, 1), from 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*salt), 11) / F.lit(float(1 << 53))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """key, source_no, source_size and target; ``by_source`` has key, source, source_size.

    A target is the source's share by weight, but at most ``max_passes`` times
    its size; what exceeds that goes to the others by weight.  With sources in
    order of cap to weight, the common level per weight is the largest of the
    levels that remain when all before are at their caps.
    """
    every = Window.partitionBy()
    in_order = every.orderBy(F.col("source").asc_nulls_last())
    tight = every.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    cap, weight = F.col("cap"), F.col("weight")
    before = lambda c: F.coalesce(F.sum(c).over(tight), F.lit(0.0))
    return (
        by_source.withColumn("source_no", F.row_number().over(in_order).cast("long"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_passes)))
        .withColumn("ratio", cap / weight)
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - before(cap)) / (F.sum(weight).over(every) - before(weight)))
        .withColumn("target", F.least(cap, weight * F.max("level").over(every)))
        .select("key", "source_no", "source_size", "target")
    )


def running_totals(df: DataFrame, group: str, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the group's earlier rows, by (part,
    order).  Sums within parts, then over the parts' sums: no group as a whole
    meets in one task.  ``group`` must not be null."""
    within = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(group, part).agg(F.sum(value).alias("_sum")).select(
        group, part, F.coalesce(F.sum("_sum").over(over_parts), F.lit(0)).alias("_base")
    )
    return (
        df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(base, [group, part])
        .withColumn(out, F.col("_base") + F.col("_within"))
        .drop("_base", "_within")
    )


class Mix:
    """A mix of ``docs``: ``documents`` (rid, doc_id, size, source_size, target,
    start) and ``spans`` (shard, slot, pass, block, rid, first_word, n_words).

    ``rid`` numbers the rows of ``rows``, so repeated doc_ids stay apart.  Null
    sources form one source, the last in order.  Null and empty texts have size
    0 and are never taken; sources without words have the target 0.  Rows of a
    source follow each other by a hash of doc_id and text, then doc_id, size and
    text hash; rows alike in all of these are interchangeable.
    """

    def __init__(self, rows: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED,
                 weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES):
        """``rows``: rid, doc_id, source, size, text_hash; read more than once."""
        key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
        keyed = rows.select("rid", "doc_id", "source", "size", "text_hash", key.alias("key"),
                            F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(PARTS)).alias("part"))
        by_source = keyed.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
        plan = targets(by_source, weights, share, max_passes)
        blocks = F.ceil(F.col("source_size") / F.lit(float(block_words))).cast("long")
        every = Window.partitionBy()
        up_to = every.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
        scratch = self.scratch = Scratch(rows.sparkSession, "mix")
        share_of = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0)
        self.plan = scratch.staged(
            plan.withColumn("n_blocks", blocks)
            .withColumn("quota", share_of.cast("long"))
            .withColumn("high", F.sum("quota").over(up_to) / F.greatest(F.sum("quota").over(every), F.lit(1)))
            .withColumn("low", F.coalesce(F.lag("high").over(every.orderBy("source_no")), F.lit(0.0))),
            "plan",
        )
        placed = running_totals(keyed, "key", "part", ["doc_id", "size", "text_hash"], "size", "start")
        self.documents = scratch.staged(
            placed.join(self.plan, "key").select("rid", "doc_id", "size", "source_size", "target", "source_no", "start"), "documents"
        )
        self.n_slots = self.plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
        self.n_tasks = min(MOST_TASKS, max(1, -(-self.n_slots // TASK_SLOTS)))
        # both sides grow with the words; their sizes after explode are not known to
        # the optimizer, which would otherwise broadcast the slots
        self.spans = self._pieces(block_words).join(self._slots(seed, shard_slots).hint("merge"), ["source_no", "block"])

    def _pieces(self, block_words: int) -> DataFrame:
        """The part of a document that lies in a block."""
        end = F.col("start") + F.col("size")
        length = F.lit(block_words)
        first = F.floor(F.col("start") / length)
        last = F.floor((end - 1) / length)
        begin = F.greatest(F.col("start"), F.col("block") * length)
        return (
            self.documents.where("size > 0")
            .select("rid", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
            .select("source_no", "block", "rid", (begin - F.col("start")).alias("first_word"),
                    (F.least(end, (F.col("block") + 1) * length) - begin).alias("n_words"))
        )

    def _drawn(self, seed: int, shard_slots: int) -> DataFrame:
        """shard, source_no and drawn: the sources' counts in each shard.

        Every slot draws its source; the shares are filed under the bins of [0, 1)
        that they touch, so a slot meets the one or few sources of its bin."""
        bins = self.scratch.staged(
            self.plan.where("quota > 0").select("source_no", "low", "high", F.explode(F.sequence(
                F.floor(F.col("low") * BINS), F.least(F.floor(F.col("high") * BINS), F.lit(BINS - 1)))).alias("bin")),
            "bins",
        )
        at = F.col("at")
        slots = (
            self.plan.sparkSession.range(0, self.n_slots, 1, self.n_tasks)
            .select(F.floor(F.col("id") / shard_slots).alias("shard"), uniform(F.lit(seed), "id").alias("at"))
            .withColumn("bin", F.floor(at * BINS))
        )
        counts = slots.join(bins, "bin").where((at >= F.col("low")) & (at < F.col("high"))).groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("drawn"))
        counts = self.scratch.staged(counts, "counts")
        sums = counts.groupBy("source_no").agg(F.sum("drawn").alias("sum"))
        lacking = self.plan.where("quota > 0").join(sums, "source_no", "left").select(
            "source_no", F.lit(-(-self.n_slots // shard_slots)).cast("long").alias("shard"), (F.col("quota") - F.coalesce("sum", F.lit(0))).alias("drawn")
        )
        return counts.union(lacking.where("drawn > 0"))

    def _slots(self, seed: int, shard_slots: int) -> DataFrame:
        """One row for each slot of each shard with the block that fills it."""
        before = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
        drawn = self._drawn(seed, shard_slots).withColumn("run", F.floor(F.col("shard") / RUN_SHARDS))
        drawn = running_totals(drawn, "source_no", "run", ["shard"], "drawn", "earlier").withColumn("below", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
        sources = self.plan.select("source_no", "n_blocks", "quota")
        number = F.col("number")
        return (
            drawn.repartition(self.n_tasks, "source_no", "shard")  # by number: spread as it is before it grows
            .select("source_no", "shard", "below", "earlier", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)).alias("i"))
            .join(sources, "source_no")
            .select("source_no", "n_blocks", "quota", "shard", (F.col("below") + F.col("i")).alias("slot"), (F.col("earlier") + F.col("i")).alias("number"))
            .where(number < F.col("quota"))  # a slot beyond the quota stays empty
            .withColumn("pass", F.floor(number / F.col("n_blocks")))
            .withColumn("block", permuted(number % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("source_no"), F.col("pass")))
            .select("source_no", "block", "shard", "slot", "pass")
        )

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and the words that the mix takes."""
        words = self.spans.groupBy("rid").agg(F.sum("n_words").alias("taken"))
        return self.documents.join(words, "rid", "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )


def sized_rows(docs: DataFrame) -> DataFrame:
    """What ``Mix`` needs of documents, written once."""
    return staged(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")),
        "mix-sizes",
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a document, a row with the words
    taken in it, in order, with their own white space; all other columns stay,
    n_chars (where there is one) follows the text.  Documents of which nothing
    is taken are left out.

    Texts are read twice and shuffled once, to meet what is taken of them: rows
    are known by two hashes of their columns (maps aside).  Rows alike in these
    are interchangeable, and one of them stands for all.
    """
    hashed = [c for c, f in zip(all_columns(docs), docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    prints = F.struct(F.xxhash64(*hashed).alias("a"), F.xxhash64(F.lit(SEED), *hashed[::-1]).alias("b"))
    rows = docs.select(F.struct(*all_columns(docs)).alias("row"), prints.alias("print"))
    scratch = Scratch(docs.sparkSession, "mix-documents")
    sizes = scratch.staged(
        rows.select(F.monotonically_increasing_id().alias("rid"), "print", "row.doc_id", "row.source",
                    word_count(F.col("row.text")).alias("size"), F.xxhash64("row.text").alias("text_hash")), "sizes"
    )
    mix = Mix(sizes)
    passes = mix.spans.groupBy("rid", "pass").agg(
        F.sum("n_words").alias("n_taken"), F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("parts")
    )
    passes = staged(passes.join(sizes.select("rid", "print", "size"), "rid").select("print", "size", "n_taken", "parts"), "mix-passes")
    repeated = staged(sizes.groupBy("print").count().where("count > 1").select("print"), "repeated-rows")
    scratch.close()
    mix.scratch.close()
    if not repeated.isEmpty():
        again = rows.join(repeated, "print", "left_semi").dropDuplicates(["print"])
        rows = rows.join(repeated, "print", "left_anti").unionByName(again)
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), 0)
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("words", (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")))), "")
    whole = F.col("n_taken") == F.col("size")
    out = (
        rows.join(passes, "print")
        .withColumn("words", F.when(~whole, words))
        .withColumn("row", F.col("row").withField("text", F.when(whole, F.col("row.text")).otherwise(cut)))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast(kind)))
    return out.select("row.*")
