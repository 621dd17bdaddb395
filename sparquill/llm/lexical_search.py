"""Ranked lexical search over a two-level quantised index.

Documents are indexed in chunks.  Of every chunk the index holds postings of
the asked terms: document, frequency, and the impact of the frequency as a byte,
rounded up.  Sums of weighted bytes bound each document's score from both sides:
a chunk whose largest bytes cannot reach an item's kth lower bound is passed over,
and in the others every document whose upper bound reaches it is scored exactly,
in 64-bit integers.  Nothing but a document that cannot be among the k best is
left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, give_back, in_pieces, small_batches, staged

# Terms are runs of 0-9, A-Z, a-z and non-ASCII characters; A-Z become a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Fixed values of the score: impact = 10^9 tf div (1000 tf + 12 m), m = 75 + 25 n N div L, weight = floor(1000 ln((2N + 2) / (2 df + 1))).
UNIT, TF_PART, LENGTH_PART, FLAT, SLOPE, WEIGHT_UNIT = 1_000_000_000, 1000, 12, 75, 25, 1000
# Parameters.
#: Of one byte of impact; an impact is below UNIT / TF_PART.
STEP = -(-UNIT // TF_PART // 255)
ITEM_BYTES = 16 << 20  # texts of items that are looked up, and broadcast, at once
SALTS = 16  # parts of an item's candidates that are cut to its k best before they meet


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(WEIGHT_UNIT * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


def norms(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document, from its number of terms."""
    if SLOPE * int(sizes.max(initial=0)) * n_docs < 1 << 63:
        return FLAT + SLOPE * sizes * n_docs // max(n_terms, 1)
    return np.array([FLAT + SLOPE * int(n) * n_docs // n_terms for n in sizes], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (TF_PART * tf + LENGTH_PART * m)


class Block:
    """Items that are looked up together: ``terms`` numbers their distinct terms."""

    def __init__(self, items: list[tuple[int | None, bytes | None]]):
        counts = [Counter(terms_of(text)) for _, text in items]
        self.ids = [i for i, _ in items]
        self.terms = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
        self.asked = [(np.array([self.terms[t] for t in c], np.int64), np.array([*c.values()], np.int64)) for c in counts]


class Chunk:
    """Postings of some documents, by term: ``starts`` bounds those of each of ``terms``."""

    def __init__(self, ids, sizes, terms, starts, docs, tf, impact=None):
        self.ids, self.sizes, self.terms, self.starts, self.docs, self.tf, self.impact = ids, sizes, terms, starts, docs, tf, impact

    @classmethod
    def of(cls, ids: list, texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[int, int, Chunk]:
        """Number of documents with terms, their terms, and the postings of those in ``vocabulary``."""
        words = [terms_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        width = max(len(words), 1)
        keys = []
        for at, own in enumerate(words):
            found = np.fromiter(map(vocabulary.get, own, repeat(-1)), np.int64, len(own))
            keys.append(found[found >= 0] * width + at)
        keys, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
        held, docs = np.unique(keys % width, return_inverse=True)
        terms, starts = np.unique(keys // width, return_index=True)
        chunk = cls([ids[i] for i in held.tolist()], sizes[held], terms.astype(np.int32), np.append(starts, len(keys)), docs.astype(np.int32), tf.astype(np.int32))
        return int((sizes > 0).sum()), int(sizes.sum()), chunk

    def quantised(self, n_docs: int, n_terms: int) -> np.ndarray:
        """Each posting's impact in STEPs, rounded up."""
        exact = impacts(self.tf.astype(np.int64), norms(self.sizes, n_docs, n_terms)[self.docs])
        return (-(-exact // STEP)).astype(np.uint8)


class Best:
    """The k best documents of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a further document's score must reach: the kth best, or 1."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        nulls = np.array([i is None for i in ids], bool)
        ids = np.array([i or 0 for i in ids], np.int64)
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


class Searcher:
    """Looks a block's items up in one chunk after the other."""

    def __init__(self, block: Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.block, self.n_docs, self.n_terms, self.k = block, n_docs, n_terms, k
        self.asked = [(terms[w > 0], w[w > 0]) for terms, counts in block.asked for w in [counts * weights[terms]]]
        self.best = [Best(k) for _ in self.asked]
        self.rescored = 0

    def look_up(self, chunk: Chunk) -> None:
        if not len(chunk.terms):
            return
        slots = np.full(len(self.block.terms), -1, np.int64)
        slots[chunk.terms] = np.arange(len(chunk.terms))
        largest = np.maximum.reduceat(chunk.impact, chunk.starts[:-1]).astype(np.int64)
        m = norms(chunk.sizes, self.n_docs, self.n_terms)
        for (terms, weights), best in zip(self.asked, self.best, strict=True):
            at = slots[terms]
            here = at >= 0
            at, weights = at[here], weights[here]
            if STEP * int((weights * largest[at]).sum()) < best.least():
                continue  # nor could any of the chunk's documents
            chosen, scores = self._scored(chunk, m, at, weights, best.least())
            if len(chosen):
                best.add(scores, [chunk.ids[i] for i in chosen.tolist()])

    def _scored(self, chunk: Chunk, m: np.ndarray, at: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose upper bound reaches ``least`` and the chunk's kth lower bound, and their scores."""
        spans = [slice(chunk.starts[s], chunk.starts[s + 1]) for s in at.tolist()]
        steps, present = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
        for span, w in zip(spans, weights.tolist(), strict=True):
            docs = chunk.docs[span]
            steps[docs] += w * chunk.impact[span].astype(np.int64)
            present[docs] += w
        upper = STEP * steps
        if len(m) > self.k:
            lower = upper - (STEP - 1) * present
            least = max(least, int(np.partition(lower, len(lower) - self.k)[len(lower) - self.k]))
        chosen = np.flatnonzero(upper >= least)
        scores = np.zeros(len(chosen), np.int64)
        for span, w in zip(spans, weights.tolist(), strict=True):
            docs = chunk.docs[span]
            place = np.minimum(np.searchsorted(docs, chosen), len(docs) - 1)
            hit = docs[place] == chosen
            scores[hit] += w * impacts(chunk.tf[span][place[hit]].astype(np.int64), m[chosen[hit]])
        self.rescored += len(chosen)
        kept = scores >= max(1, least)
        return chosen[kept], scores[kept]


PARTS = {"sizes": np.int64, "terms": np.int32, "starts": np.int64, "docs": np.int32, "tf": np.int32}
CHUNK_SCHEMA = "n_docs long, n_terms long, ids array<long>, " + ", ".join(f"{p} binary" for p in PARTS)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each chunk of ``docs``: counts, and its postings as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", BATCH_BYTES):
            n_docs, n_terms, chunk = Chunk.of(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), shared.value)
            parts = [pa.array([np.ascontiguousarray(getattr(chunk, p), kind).tobytes()], pa.binary()) for p, kind in PARTS.items()]
            counts = [pa.array([x], pa.int64()) for x in (n_docs, n_terms)]
            yield pa.RecordBatch.from_arrays([*counts, pa.array([chunk.ids], pa.list_(pa.int64())), *parts], ["n_docs", "n_terms", "ids", *PARTS])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, CHUNK_SCHEMA)


def chunks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for at in range(batch.num_rows):
            parts = {p: np.frombuffer(batch.column(p)[at].as_buffer(), kind) for p, kind in PARTS.items()}
            impact = np.frombuffer(batch.column("impact")[at].as_buffer(), np.uint8) if "impact" in batch.schema.names else None
            yield Chunk(batch.column("ids")[at].as_py(), **parts, impact=impact)


def frequencies(chunks: DataFrame, n_terms: int) -> np.ndarray:
    """Of each numbered term the documents that hold it: a row for each term and task is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                total[np.frombuffer(terms.as_buffer(), np.int32)] += np.diff(np.frombuffer(starts.as_buffer(), np.int64))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for term, n in chunks.select("terms", "starts").mapInArrow(count, "term long, n long").groupBy("term").sum("n").collect():
        out[term] = n
    return out


def indexed(chunks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``chunks`` and their postings' quantised impacts."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in enumerate(chunks_in([batch])):
                one = batch.slice(at, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([chunk.quantised(n_docs, n_terms).tobytes()], pa.binary())], [*one.schema.names, "impact"])

    return chunks.mapInArrow(quantise, CHUNK_SCHEMA + ", impact binary")


def ranked(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """item (its place in ``block``), rank, doc_id and score of each item's k best."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "postings")
    chunks = scratch.staged(postings(docs, block.terms), "postings")
    n_docs, n_terms = (x or 0 for x in chunks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.array([weight(n_docs, int(df)) for df in frequencies(chunks, len(block.terms))], np.int64)
    index = staged(indexed(chunks, n_docs, n_terms), "lexical-index")
    scratch.close()
    shared = spark.sparkContext.broadcast((block, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, n_docs, n_terms, k)
        for chunk in chunks_in(batches):
            searcher.look_up(chunk)
        found = [(np.full(len(b.ids), i), b) for i, b in enumerate(searcher.best) if len(b.ids)]
        if found:
            ids, nulls, scores = (np.concatenate([getattr(b, name) for _, b in found]) for name in ("ids", "nulls", "scores"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i for i, _ in found])), pa.array(ids, mask=nulls), pa.array(scores)], ["item", "doc_id", "score"])
        give_back()

    found = index.mapInArrow(search, "item long, doc_id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
    for keys in (("item", "salt"), ("item",)):  # every task has k rows of an item: salted first, so that none meets all of them
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def item_blocks(items: DataFrame) -> list[DataFrame]:
    """``items`` in parts whose texts, as measured, have ITEM_BYTES at most (or are one text)."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id", "text", F.lit(n)), F.lit(n))
        sizes = items.groupBy(block.alias("b")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size"), F.count(F.lit(1)).alias("rows"))
        if not sizes.where((F.col("size") > ITEM_BYTES) & (F.col("rows") > 1)).head(1):
            return [items.where(block == b) for b in range(n)]
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: for each row of ``items`` its ``k``
    highest-scoring documents with a score above 0 (all, if fewer), equal scores
    by doc_id, null last.

    Null and empty texts have no terms: such items get no rows, such documents
    take no part and are not counted.  Rows that repeat a doc_id are documents of
    their own; items that repeat an item_id are answered each by its own text,
    and whole repeated rows once for each.  An empty table on either side gives no
    rows.  Texts of any length are read whole; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    asked = staged(items.select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies")), "items")
    parts = []
    for part in item_blocks(asked):
        rows = part.orderBy("item_id", "text").collect()  # ITEM_BYTES at most
        block = Block([(r["item_id"], r["text"].encode() if r["text"] else None) for r in rows])
        names = docs.sparkSession.createDataFrame([(i, r["item_id"], r["copies"]) for i, r in enumerate(rows)], "item long, item_id long, copies long")
        found = ranked(docs, block, k).join(F.broadcast(names), "item")
        parts.append(found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, parts)


def oracle(k: int = 20) -> str:
    """DuckDB: every score of every pair that shares a term."""
    term = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    with d as (select row_number() over () as doc_no, doc_id, regexp_extract_all({lower}, '{term}') as terms from documents),
    sized as (select doc_no, doc_id, terms, len(terms) as n from d where len(terms) > 0),
    total as (select count(*) as docs, sum(n)::bigint as terms from sized),
    tf as (select doc_no, term, count(*) as tf from (select doc_no, unnest(terms) as term from sized) group by all),
    w as (select term, floor({WEIGHT_UNIT} * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term) cross join total),
    asked as (
      select item_no, item_id, term, count(*) as times from (
        select row_number() over () as item_no, item_id, unnest(regexp_extract_all({lower}, '{term}')) as term from benchmark) group by all),
    scored as (
      select a.item_no, a.item_id, s.doc_id, s.doc_no,
        sum(a.times * w.w * (({UNIT} * tf.tf) // ({TF_PART} * tf.tf + {LENGTH_PART} * ({FLAT} + ({SLOPE} * s.n * t.docs) // t.terms))))::bigint as score
      from asked a join w using (term) join tf using (term) join sized s using (doc_no) cross join total t group by all),
    best as (select *, row_number() over (partition by item_no order by score desc, doc_id) as rn from scored where score > 0)
    select item_id, rn::integer as rank, doc_id, score from best where rn <= {k}"""
