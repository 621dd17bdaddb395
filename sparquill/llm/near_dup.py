"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set holds the 64-bit hashes of its distinct word shingles.  Equal
sets become one node.  Nodes that agree in all rows of a band share a bucket;
each is paired with the bucket's first and last node.  An odd sketch (the parity
of how often each bit is hit by the MinHash samples) tells from the population
count of an XOR which pairs are too far apart; the rest is confirmed on the full
sets.  Where a bucket's nodes are then still in several components, the nodes
outside its largest one are held against all others of the bucket in the same
way, so that no link hangs on the choice of the pair's partner.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_columns, Scratch, give_back, in_pieces, staged

# Parameters.
SAMPLES, SKETCH_BITS = 168, 1024  # MinHash samples of a set, and its odd sketch
MISS = 4e-6  # largest chance that no band brings a pair at the threshold together
MARGIN = 0.17  # below the threshold; see the README for how rarely a pair falls below it
#: The same for nodes of buckets that hold several components, where pairs are many.
WIDE_SAMPLES, WIDE_BITS, WIDE_MARGIN = 2048, 8192, 0.05
SEED = 9127
#: Ids of documents are broadcast up to so many bytes, counted before.
BROADCAST_BYTES = 32 << 20
#: Nodes of a bucket that meet in one task; larger buckets are dealt out by pairs of blocks.
BLOCK_NODES = 2048
#: Words that are hashed at once, and bytes of texts of one batch of sets.
CHUNK_WORDS, SET_BYTES = 200_000, 4 << 20


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles are linked at ``percent`` % similarity or more."""

    words: int
    percent: int

    def bands(self) -> tuple[int, int]:
        """Rows and number: the longest bands that miss seldom enough."""
        t = self.percent / 100
        rows = max(r for r in range(1, SAMPLES + 1) if r == 1 or (1 - t**r) ** (SAMPLES // r) <= MISS)
        return rows, SAMPLES // rows


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.  Words are split at
    ASCII white space after A-Z became a-z; fewer than k words are one shingle."""
    done = 0
    while done < len(texts):
        words, ends = [], []
        while done < len(texts) and (not words or len(words) < CHUNK_WORDS):
            text = texts[done]
            words += text.encode().lower().split() if text else []
            ends.append(len(words))
            done += 1
        hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
        n = max(0, len(hashes) - k + 1)
        joined = hashes[:n].copy()
        for j in range(1, k):
            joined = _mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
        start = 0
        for end in ends:
            if end - start >= k:
                yield np.unique(joined[start : end - k + 1])
            elif end > start:
                whole = np.array([end - start], np.uint64)
                for h in hashes[start:end]:
                    whole = _mix(whole * np.uint64(0xD6E8FEB86659FD93) + h)
                yield whole
            else:
                yield np.zeros(0, np.uint64)
            start = end


class Sketcher:
    def __init__(self, rule: Rule, samples: int = SAMPLES, bits: int = SKETCH_BITS):
        self.rows, self.bands = rule.bands()
        self.n, self.bits = samples, bits
        random = np.random.default_rng(SEED)
        self.factor = random.integers(0, 1 << 31, samples, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.shift = random.integers(0, 1 << 32, samples, np.uint64).astype(np.uint32)[:, None]
        self.place = random.integers(0, 1 << 63, samples, np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.n, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(short), 512):
            np.minimum(least, (self.factor * short[i : i + 512] + self.shift).min(axis=1), out=least)
        return least.astype(np.uint64)

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One bucket key for each band; the band's number is part of it."""
        rows = samples[: self.rows * self.bands].reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        return key.view(np.int64)

    def parity(self, samples: np.ndarray) -> np.ndarray:
        """The odd sketch as 64-bit words."""
        hit = _mix(samples + self.place) % np.uint64(self.bits)
        bits = np.bincount(hit.astype(np.int64), minlength=self.bits) & 1
        return np.packbits(bits.astype(np.uint8)).view(np.int64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: sums of two hashes of its members."""
    with np.errstate(over="ignore"):
        sums = np.array([_mix(shingles).sum(dtype=np.uint64), _mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    a, b = sums.view(np.int64).tolist()
    return a, b


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, fa, fb, bands and sketch of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(rule)
        for batch in in_pieces(batches, "text", SET_BYTES):
            rows, bands, sketches = [], [], []
            for shingles in shingle_sets(batch.column(1).to_pylist(), rule.words):
                rows.append((len(shingles), *fingerprint(shingles)))
                samples = sketcher.samples(shingles)
                bands.append(sketcher.keys(samples))
                sketches.append(sketcher.parity(samples))
            sizes, fa, fb = zip(*rows, strict=True)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(x), pa.int64()), n).cast(pa.list_(pa.int64()))
                     for x, n in ((bands, sketcher.bands), (sketches, SKETCH_BITS // 64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (sizes, fa, fb)], *lists],
                ["doc_id", "n_shingles", "fa", "fb", "bands", "sketch"],
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind}, n_shingles long, fa long, fb long, bands array<long>, sketch array<long>"
    )


def estimate(a: Column, b: Column, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> Column:
    """Similarity of two sets by their odd sketches: the XOR has one bit for
    each odd bin of the samples that differ."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    share = F.least(differ / F.lit(float(bits)), F.lit(0.4999))
    return 1 + F.lit(bits / (4.0 * samples)) * F.log(1 - 2 * share)


def may_link(x: str, y: str, rule: Rule, margin: float = MARGIN, **sketch: int) -> Column:
    """Neither the sizes nor the sketches rule a link out."""
    small, large = F.least(f"{x}.n_shingles", f"{y}.n_shingles"), F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    return (100 * small >= rule.percent * large) & (estimate(F.col(f"{x}.sketch"), F.col(f"{y}.sketch"), **sketch) >= rule.percent / 100 - margin)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """node and shingles (sorted uint64) of rows whose text is the node's own; another
    row with the same doc_id may hold another text."""
    for batch in in_pieces(batches, "text", SET_BYTES):
        nodes, fa, fb = (batch.column(c).to_pylist() for c in ("node", "fa", "fb"))
        ids, sets = [], []
        for node, a, b, shingles in zip(nodes, fa, fb, shingle_sets(batch.column("text").to_pylist(), words), strict=True):
            if fingerprint(shingles) == (a, b):
                ids.append(node)
                sets.append(shingles.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])
    give_back()


class Linker:
    def __init__(self, docs: DataFrame, rule: Rule):
        self.docs, self.rule = docs.select("doc_id", "text"), rule
        self.scratch = Scratch(docs.sparkSession, "near-dup")
        self.signed = self.scratch.staged(signatures(self.docs, rule), "signatures")
        whole = self.signed.where("n_shingles > 0 and doc_id is not null").groupBy("fa", "fb", "n_shingles")
        self.nodes = self.scratch.staged(
            whole.agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
            .withColumn("node", F.monotonically_increasing_id()),
            "nodes",
        )

    def components(self) -> DataFrame:
        """node and component, for nodes with links."""
        keep, drop = self.scratch.staged, self.scratch.drop
        members = self.nodes.select("node", F.explode("bands").alias("key"))
        buckets = keep(
            members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"), "buckets"
        )
        ends = members.join(buckets, "key").select("node", F.explode(F.array("low", "high")).alias("other")).where("node != other")
        tried = self._near(ends.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
        links = self._confirmed(tried)
        found = connected(links, self.scratch)
        left_over = self._left_over(members, buckets.where("n > 2"), found, tried)
        drop(tried, buckets)
        more = self._confirmed(left_over)
        if more.isEmpty():
            return found
        return connected(links.union(more), self.scratch)

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that may be linked."""
        side = self.nodes.select("node", "n_shingles", "sketch")
        x = side.select(F.col("node").alias("a"), F.struct("n_shingles", "sketch").alias("x"))
        y = side.select(F.col("node").alias("b"), F.struct("n_shingles", "sketch").alias("y"))
        pairs = self.scratch.staged(pairs, "pairs")
        near = self.scratch.staged(pairs.join(x, "a").join(y, "b").where(may_link("x", "y", self.rule)).select("a", "b"), "near-pairs")
        self.scratch.drop(pairs)
        return near

    def _left_over(self, members: DataFrame, buckets: DataFrame, found: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs of one bucket, not tried yet, that may join two components.

        A bucket of more than BLOCK_NODES nodes is dealt out by pairs of blocks,
        so that no task holds its nodes against each other alone."""
        keep, drop = self.scratch.staged, self.scratch.drop
        labelled = keep(
            members.join(buckets.select("key", "n"), "key").join(found, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("component")),
            "labelled",
        )
        split = labelled.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("key")
        # written, so that components are counted by (key, component) and not all of a key in one task
        sizes = keep(labelled.join(split, "key").groupBy("key", "component").count(), "sizes")
        main = keep(sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main")), "mixed-buckets")
        mixed = keep(labelled.join(main, "key").select("key", "n", "node", "component", "main"), "mixed-members")
        drop(labelled, main, sizes)
        sketches = self._wide_sketches(mixed.select("node").distinct())
        rows = keep(mixed.join(sketches, "node"), "mixed-sketches")
        side = F.struct("node", "component", "main", "n_shingles", "bands", "sketch")
        last = F.floor((F.col("n") - 1) / BLOCK_NODES)
        own, others = F.pmod(F.xxhash64("node"), last + 1), F.explode(F.sequence(F.lit(0).cast("long"), last))
        x = rows.where("component != main").select("key", own.alias("i"), others.alias("j"), side.alias("x"))
        y = rows.select("key", others.alias("i"), own.alias("j"), side.alias("y"))
        apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        near = may_link("x", "y", self.rule, WIDE_MARGIN, samples=WIDE_SAMPLES, bits=WIDE_BITS)
        # of the bands that a pair shares, only the first brings it forward
        common = F.filter(F.zip_with("x.bands", "y.bands", lambda p, q: F.when(p == q, p)), lambda k: k.isNotNull())
        pairs = x.join(y, ["key", "i", "j"]).where(apart & near & (F.try_element_at(common, F.lit(1)) == F.col("key")))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        out = keep(pairs.join(tried, ["a", "b"], "left_anti"), "left-over-pairs")
        drop(mixed, rows)
        return out

    def _wide_sketches(self, nodes: DataFrame) -> DataFrame:
        """node, n_shingles, bands and a long odd sketch of the given nodes."""
        rule = self.rule

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketcher = Sketcher(rule, WIDE_SAMPLES, WIDE_BITS)
            for batch in _sets(batches, rule.words):
                made = [sketcher.parity(sketcher.samples(np.frombuffer(s.as_buffer(), np.uint64))) for s in batch.column("shingles")]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.list_(pa.int64()))], ["node", "sketch"])

        made = self.scratch.staged(self._texts(nodes).mapInArrow(sketch, "node long, sketch array<long>"), "wide-sketches").dropDuplicates(["node"])
        return made.join(self.nodes.select("node", "n_shingles", "bands"), "node")

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """node, fa, fb and text of the given nodes, and of rows that only share the doc_id."""
        wanted = self.scratch.staged(nodes.join(self.nodes, "node").select("node", "first_doc", "fa", "fb"), "wanted")
        size = wanted.agg(F.sum(24 + F.octet_length(F.col("first_doc").cast("string")))).first()[0] or 0
        ids = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
        return self.docs.join(ids, F.col("doc_id") == F.col("first_doc")).select("node", "fa", "fb", "text")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose full sets are similar enough."""
        words = self.rule.words
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = self.scratch.staged(self._texts(nodes).mapInArrow(lambda b: _sets(b, words), "node long, shingles binary"), "sets")
        percent = self.rule.percent

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = []
                for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        kept.append(i)
                yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
            give_back()

        x, y = sets.toDF("b", "x"), sets.toDF("a", "y")
        links = self.scratch.staged(pairs.join(x, "b").join(y, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct(), "links")
        self.scratch.drop(sets)
        return links

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, fa, fb, component_id and group (a number for each
        component; two may have the same doc_id) of each row.  Only what has a set looks for its component; the copies of a text are split between
        tasks where Spark finds their key skewed."""
        found = self.components()
        lowest = self.nodes.join(found, "node").groupBy("component").agg(F.min("first_doc").alias("component_id"))
        named = self.scratch.staged(
            self.nodes.select("node", "fa", "fb", "n_shingles", "first_doc")
            .join(found, "node", "left").join(lowest, "component", "left")
            .select("fa", "fb", "n_shingles", F.coalesce("component_id", "first_doc").alias("component_id"), F.coalesce("component", "node").alias("group")),
            "components",
        )
        rows = self.signed.select("doc_id", "n_shingles", "fa", "fb")
        linked = rows.where("n_shingles > 0").join(named, ["fa", "fb", "n_shingles"], "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        empty = rows.where("n_shingles = 0").select("*", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
        both = linked.select(*rows.columns, own.alias("component_id"), "group").union(empty)
        out = staged(both, "near-duplicates")
        self.scratch.close()
        return out


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (its smallest node) of links (a, b), by turns of
    large-star and small-star steps until nothing changes."""

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    keep = scratch.staged
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        both = keep(edges.union(edges.select("b", "a")).toDF("u", "v"), "cc")
        least = keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "cc")
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        lower = keep(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        star = large.join(lower, "u")
        new = keep(star.select("u", "m").union(star.where("v != m").select("v", "m")).toDF("a", "b").distinct(), "cc")
        scratch.drop(edges, both, least, large, lower)
        edges, now = new, state(new)
        if now == before:
            return edges.union(edges.select("b", "b")).distinct().toDF("node", "component")
        before = now


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Texts without words (null, empty) have an empty set and link with nothing,
    nor do rows without doc_id: their component is themselves (null where
    doc_id is) and they are kept.  Repeated rows each get a row; kept is doc_id =
    component_id, for each row by its own text.  Texts of any length are read
    whole, an empty table gives no rows, other columns are ignored.
    """
    return _judged(docs, rule).drop("fa", "fb", "group")


def _judged(docs: DataFrame, rule: Rule) -> DataFrame:
    return Linker(docs, rule).documents().withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns; of a group's rows
    with the same doc_id one stays.  Rows without doc_id all stay.

    Texts meet only the ids that go: an anti join, which Spark broadcasts while
    that table is small.
    """
    judged = _judged(docs, rule).where("doc_id is not null")
    by_id = judged.groupBy("doc_id").agg(F.count_if("kept").alias("good"), F.count_if(~F.col("kept")).alias("bad"))
    odd = staged(by_id.where("bad > 0 or good > 1"), "odd-ids")  # some row of theirs goes
    columns, named = all_columns(docs), docs.where("doc_id is not null")
    rest = docs.where("doc_id is null").union(named.join(odd.select("doc_id"), "doc_id", "left_anti").select(*columns))
    again = odd.where("good > 0")
    if again.isEmpty():
        return rest

    # a doc_id comes more than once: its rows are told apart by their own texts
    @F.pandas_udf("fa long, fb long")
    def printed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fingerprint(s) for s in shingle_sets(texts.tolist(), rule.words)], columns=["fa", "fb"])

    good = judged.where("kept").join(again, "doc_id", "left_semi").groupBy("doc_id", "group").agg(F.min(F.struct("fa", "fb")).alias("print"))
    split = named.join(again, "doc_id", "left_semi").select("doc_id", F.struct(*columns).alias("row"), printed("text").alias("print"))
    one = split.join(good, ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id", "print"])
    return rest.union(one.select("row.*"))
