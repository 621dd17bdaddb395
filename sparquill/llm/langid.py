"""Languages of words, spans and whole texts.

Letters' script ranges leave a word with the languages that use the scripts of
most of its letters.  Character trigrams, with word ends, score each word for each language.  The
best path over a text's words, with a penalty for every change of language,
labels spans of mixed-language text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, once, staged
from .quality_model import held_out

# Parameters.
SAMPLE = 8192  # labelled texts of a language that fit its scores: all up to here, about so many of more
BINS = 1 << 16  # of hashed trigrams
SWITCH = 14.0  # penalty, in nats, for a change of language
WORD_LIMIT = 5.0  # most that one word may speak for a language among those of its script, in nats
BARRED = 1000.0  # nats against a language that does not use the word's script: more than any run of words gains by it
SCRIPT_SHARE = 0.02  # of a language's letters, from which it uses a script
FIT_PARTS = 8
CHUNK_CHARS = 2_000_000
UNDETERMINED = "und"

# First and last code point of script ranges.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)),
}


@cache
def letters() -> np.ndarray:
    """For every code point 0 if it is no letter, else 1 + the number of its script."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    kinds = np.full(0x110000, len(SCRIPTS) + 1, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            kinds[low : high + 1] = i
    return out * kinds


class Words:
    """The words (runs of letters) of several texts, with their trigrams."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join((t or "").lower() for t in texts)
        ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])
        code = np.concatenate([[10], np.frombuffer(joined.encode("utf-32-le"), np.uint32), [10]]).astype(np.uint32)
        script = letters()[code]
        code = np.where(script > 0, code, np.uint32(0))
        at = np.flatnonzero(script)  # positions of letters, shifted by one
        mixed = (code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        self.trigrams = mixed >> np.uint32(16)
        self.starts = np.flatnonzero(code[at - 1] == 0)  # into the letters
        self.sizes = np.diff(np.append(self.starts, len(at)))
        self.letter_scripts = script[at]
        #: First word of each text, and one after the last.
        self.bounds = np.concatenate([[0], np.searchsorted(at[self.starts] - 1, ends)])


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, texts: np.ndarray):
        """Trigram counts (languages, BINS), letters by script, texts."""
        self.languages = languages
        share = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BINS)
        self.scores = np.ascontiguousarray(np.log(share).T, np.float32)
        used = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE
        self.uses = used.T  # (scripts, languages)
        self.prior = int(texts.argmax())

    def candidates(self, words: Words) -> np.ndarray:
        """(words, languages): those that use the scripts of most of a word's letters;
        all of them for a word in scripts that no language uses."""
        first = words.letter_scripts[words.starts]
        out = self.uses[first]
        mixed = np.add.reduceat((words.letter_scripts != np.repeat(first, words.sizes)).astype(np.int64), words.starts) > 0
        for i in np.flatnonzero(mixed):
            start = words.starts[i]
            held = self.uses[words.letter_scripts[start : start + words.sizes[i]]].sum(axis=0)
            out[i] = (held == held.max()) & (held > 0)
        out[~out.any(axis=1)] = True
        return out

    def word_scores(self, words: Words) -> np.ndarray:
        """(words, languages): nats below the best candidate, limited per word;
        BARRED for languages that are none."""
        if not len(words.starts):
            return np.zeros((0, len(self.languages)))
        out = np.add.reduceat(self.scores[words.trigrams], words.starts, axis=0).astype(np.float64)
        first = words.letter_scripts[words.starts]
        out[~self.uses[first].any(axis=1)] = 0  # no language uses the script: no evidence
        fits = self.candidates(words)
        out -= np.where(fits, out, -np.inf).max(axis=1, keepdims=True)
        return np.where(fits, np.clip(out, -WORD_LIMIT, 0), -BARRED)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word on the best path.

        One language throughout is best if no run of words gains half the
        penalty by another language; only other texts need the full search.
        """
        main = int(scores.sum(axis=0).argmax())
        sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores - scores[:, main : main + 1], axis=0)])
        if (sums - np.minimum.accumulate(sums, axis=0)).max() <= SWITCH / 2:
            return np.full(len(scores), main)
        best, back = scores[0].tolist(), []
        for row in scores[1:].tolist():
            top = max(best)
            source, moved = best.index(top), top - SWITCH
            back.append([i if b >= moved else source for i, b in enumerate(best)])
            best = [(b if b >= moved else moved) + s for b, s in zip(best, row, strict=True)]
        at = best.index(max(best))
        out = [at]
        for previous in reversed(back):
            out.append(at := previous[at])
        return np.array(out[::-1])

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, its share of the letters, and spans (first word, words,
        language) of each text."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars < CHUNK_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            words = Words(texts[start:stop])
            scores = self.word_scores(words)
            for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                if a == b:
                    yield UNDETERMINED, 0.0, []
                    continue
                part = scores[a:b]
                path = self.path(part) if part.any() else np.full(b - a, self.prior)
                held = np.bincount(path, weights=words.sizes[a:b], minlength=len(self.languages))
                main = int(held.argmax())
                first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
                sizes = np.diff(np.append(first, len(path)))
                spans = [(int(f), int(n), self.languages[path[f]]) for f, n in zip(first, sizes, strict=True)]
                yield self.languages[main], float(held[main] / held.sum()), spans
            start = stop


def fit(docs: DataFrame, learn_from: Column) -> Model | None:
    """From whole texts of each language, chosen by a hash of doc_id among
    those with ``learn_from``; None if there are none.

    A language with at most SAMPLE documents is learnt from all of them, a larger
    one from those whose hash lies in a range that holds SAMPLE on average.
    """
    labelled = staged(
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learn_from).groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("copies")),
        "language-ids",
    )
    held = staged(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("held")), "languages")
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))  # from 0 to 1
    chosen = staged(labelled.join(F.broadcast(held), "lang").where(at * F.col("held") <= SAMPLE).select("doc_id", "lang", "copies"), "language-sample")
    n_scripts = len(SCRIPTS) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words([text])
                own = sums.setdefault(lang, [np.zeros(BINS, np.int64), np.zeros(n_scripts, np.int64)])
                own[0] += np.bincount(words.trigrams, minlength=BINS)
                own[1] += np.bincount(words.letter_scripts, minlength=n_scripts)
        give_back()
        rows = [(k, a.astype(np.float32).tobytes(), b.tobytes()) for k, (a, b) in sums.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        kinds = [pa.string(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "trigrams", "scripts"])

    # the sample has about SAMPLE rows of a language at most, so it may be broadcast and meet in few parts
    texts = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    if not chosen.where("copies > 1").isEmpty():  # of texts that share a doc_id and language one stands for all, so the sample stays bounded
        texts = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.select("lang", "text").repartition(FIT_PARTS).mapInArrow(count, "lang string, trigrams binary, scripts binary").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    counts, scripts, n = np.zeros((len(languages), BINS)), np.zeros((len(languages), n_scripts)), np.zeros(len(languages))
    for r in rows:
        i = languages.index(r["lang"])
        counts[i] += np.frombuffer(r["trigrams"], np.float32)
        scripts[i] += np.frombuffer(r["scripts"], np.int64)
    for r in held.collect():  # of all documents, not of the sample
        n[languages.index(r["lang"])] = r["held"]
    return Model(languages, counts, scripts, n)


LABELLED = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("lang", T.StringType())]))),
])


def identify(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans for each row of ``docs``.

    Rows whose crc32(doc_id) mod ``parts`` is ``part`` are held out of fitting.
    Texts without a letter (null, empty) are ``und`` with score 0 and no spans;
    so are all if no row has a language.  A word belongs to a language that uses
    its script; words in scripts that none uses follow their neighbours, and alone
    fall to the most frequent language.  Of languages that score alike the first in
    order counts.  Repeated rows are labelled alike, texts of any length are read
    whole, an empty table gives no rows, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out(F.col("doc_id"), parts, part)))

    @once
    @F.pandas_udf(LABELLED)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = model.value.label(texts.tolist()) if model.value else ((UNDETERMINED, 0.0, []) for _ in texts)
            out = [(lang, score, [dict(zip(("first_word", "n_words", "lang"), s, strict=True)) for s in spans]) for lang, score, spans in rows]
            yield pd.DataFrame(out, columns=["lang_pred", "score", "spans"])
        give_back()

    rows = docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), label("text").alias("found"))
    return rows.select("doc_id", "held_out", "found.*")
