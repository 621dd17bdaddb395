"""Quality by the votes of the nearest labelled texts in a latent space.

A text's terms are its words, the shapes of its words (letters, capitals, digits
and runs of them folded; signs kept) and whether words repeat the one before.  Every
term counts: it is hashed into one of BINS bins of its kind.  TF-IDF
rows of a bounded labelled sample give latent axes by an eigendecomposition.
The sample's latent vectors are broadcast; blocked matrix products give the
exact cosine of every document with every one of them, and the nearest vote
with weights that grow with similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import all_columns, give_back, once, staged

# Parameters.
SAMPLE = 4096  # labelled texts, the bound of everything that is learnt or broadcast
BINS = 512  # of shapes, and as many of words
WEIGHT = {"shape": 1.0, "word": 0.5}  # of a term's TF-IDF
AXES = 32
NEIGHBOURS = 25
SHARPNESS = 6.0  # power of the similarity in a vote
BLOCK = 128  # documents of one matrix product
DIGITS = 6  # to which cosines are compared, so that equal texts are equally near

_SHAPE = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256)
)


def bins_of(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The bins of a text's shapes, then words, and repeats of the word before (the
    last bin), with how often each occurs; and the number of words."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    raw = text.encode()
    shape = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    folded = shape[np.concatenate([[True], shape[1:] != shape[:-1]])].tobytes()
    words = raw.split()
    counts = np.zeros(2 * BINS + 1, np.int64)
    for offset, terms in ((0, folded.split()), (BINS, raw.lower().split())):
        for term, n in Counter(terms).items():
            counts[offset + zlib.crc32(term) % BINS] += n
    counts[-1] = sum(map(eq, words, words[1:]))
    held = np.flatnonzero(counts)
    return held, counts[held], len(words)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def frequencies(texts: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """One row for each text: the shares of its words that fall into each bin."""
    out = np.zeros((len(texts), 2 * BINS + 1), np.float32)
    for row, (held, counts, n) in zip(out, texts, strict=True):
        row[held] = counts / max(1, n)
    return out


class Model:
    """Fitted on the bins of the sample's texts, which come in the order of doc_id."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray, int]], labels: list[int]):
        self.labels = np.array(labels, np.float64)
        rows = frequencies(texts)
        kinds = np.repeat(np.array([WEIGHT["shape"], WEIGHT["word"], WEIGHT["shape"]], np.float32), [BINS, BINS, 1])
        self.idf = (np.log((len(texts) + 1) / (np.count_nonzero(rows, axis=0) + 1)) + 1).astype(np.float32) * kinds
        np.sqrt(rows, out=rows)
        rows *= self.idf
        gram = np.zeros((rows.shape[1], rows.shape[1]))
        for start in range(0, len(rows), BLOCK):  # in blocks, as the driver holds this
            part = rows[start : start + BLOCK].astype(np.float64)
            gram += part.T @ part
        _, vectors = np.linalg.eigh(gram)
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :AXES], np.float32)
        self.latent = unit(rows @ self.axes)
        self.prior = float(self.labels.mean())

    def rows(self, share: np.ndarray) -> np.ndarray:
        return np.sqrt(share) * self.idf

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for start in range(0, len(texts), BLOCK):
            latent = unit(self.rows(frequencies([bins_of(t) for t in texts[start : start + BLOCK]])) @ self.axes)
            cosine = np.round(latent @ self.latent.T, DIGITS)
            weight = np.where(self.nearest(cosine), np.maximum(cosine, 0), 0).astype(np.float64) ** SHARPNESS
            out[start : start + BLOCK] = (weight @ self.labels + 1e-9 * self.prior) / (weight.sum(axis=1) + 1e-9)
        return np.clip(out, 0.0, 1.0)

    @staticmethod
    def nearest(cosine: np.ndarray) -> np.ndarray:
        """Which NEIGHBOURS of the sample vote for each row: of equally near ones the smaller doc_ids."""
        k = min(NEIGHBOURS, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
        above, tied = cosine > last, cosine == last
        return above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column) -> Model | None:
    """From at most SAMPLE labelled documents, chosen by a hash of doc_id among
    those with ``learn_from``; None if there are none."""
    sample = staged(
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn_from)
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE),
        "labelled",
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bins_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)], pa.array([f[2] for f in found], pa.int64())],
                ["doc_id", "quality", "bins", "counts", "n_words"],
            )

    # the sample has SAMPLE rows at most, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    counted = texts.mapInArrow(count, f"doc_id {kind}, quality int, bins array<long>, counts array<long>, n_words long")
    # a doc_id may come more than once: of its texts the one with the least hash stands for it
    held = staged(counted.withColumn("order", F.xxhash64("bins", "counts", "n_words")), "term-counts")
    first = held.groupBy("doc_id").agg(F.min("order").alias("order"))
    held = held.join(F.broadcast(first), ["doc_id", "order"]).dropDuplicates(["doc_id"])
    rows = held.orderBy("doc_id").toArrow()  # SAMPLE rows of no more than 2 * BINS + 1 bins
    pairs = [[x.values.to_numpy() for x in rows.column(c)] for c in ("bins", "counts")]
    texts = list(zip(*pairs, rows.column("n_words").to_pylist(), strict=True))
    model = Model(texts, rows.column("quality").to_pylist()) if texts else None
    del rows, pairs, texts
    give_back()
    return model


def scorer(docs: DataFrame, model: Model | None):
    """A function of the text column: score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @once
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series(own.scores(texts.tolist()) if own else np.full(len(texts), 0.5))
        give_back()

    return score


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Rows whose crc32(doc_id) mod ``parts`` is ``part`` are held out of fitting.
    Null and empty texts are near no labelled text and get the sample's share
    of good ones; without labels every score is 0.5.  Labels other than 0 and 1
    and labels without a document are ignored; of several for one doc_id the
    larger counts.  Of labelled texts that are equally near at the last place
    those with smaller doc_ids vote.  Texts of any length are read whole.  Repeated
    rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels, ~held_out(F.col("doc_id"), parts, part))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), scorer(docs, model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns; the
    model is fitted on ``labelled`` documents, less those that ``classify`` holds out."""
    score = scorer(docs, fit(labelled, labels, ~held_out(F.col("doc_id"), 3, 1)))
    return docs.select(F.struct(*all_columns(docs)).alias("row"), score("text").alias("score")).where("score >= 0.5").select("row.*")
