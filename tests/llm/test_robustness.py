"""Long texts against the same work done in one piece, null tables, clashing names."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparquill.llm import ann, bpe, catalog, html_extract, langid, license_scan, mixing, near_dup, quality_model, quality_rules, url_filter
from sparquill.llm.common import in_pieces

PATH = public_tokenizers.path(catalog.VOCABULARY)


@pytest.fixture(scope="module")
def long_text():
    random_ = random.Random(11)
    words = ["".join(random_.choices("abcdefgh éß", k=random_.randint(2, 9))).strip() or "x" for _ in range(5000)]
    return " ".join(random_.choices(words, k=900_000))


def test_pieces_are_whole_batches(long_text):
    texts = ["a", None, "", long_text, "b", long_text[:1000]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    pieces = list(in_pieces([batch, batch.slice(6)], "text", 1000))
    assert [x for p in pieces for x in p.column(1).to_pylist()] == texts and len(pieces) > 2


def test_long_texts_are_encoded_whole(long_text):
    with open(PATH, "rb") as f:
        data = f.read()
    assert len(long_text.encode()) > bpe.BATCH_BYTES
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.parse(data).ranks, special_tokens={})
    texts = ["a b", long_text, None, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [ids for b in bpe.encode_batches([batch], data, public_tokenizers.PATTERN) for ids in b.column("ids").to_pylist()]
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_other_patterns_take_no_short_cut():
    with open(PATH, "rb") as f:
        vocabulary = bpe.Vocabulary.parse(f.read())
    import tiktoken

    pattern = r"\S\S? ?|\s+|."
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = ["hello there you", "a\n\nb  c", "", "étage"]
    got = bpe.Tokenizer(vocabulary, pattern).encode_all(pa.array(texts)).to_pylist()
    assert got == [library.encode_ordinary(t) for t in texts]


def test_long_sets_equal_those_made_alone(long_text):
    texts = ["one two three four", long_text, None, "one two three four", "a b"]
    together = list(near_dup.shingle_sets(texts, 3))
    alone = [next(near_dup.shingle_sets([t], 3)) for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone, strict=True)) and len(together[1]) > near_dup.CHUNK_WORDS
    words = long_text.lower().split()[:3000]
    assert len(next(near_dup.shingle_sets([" ".join(words)], 3))) == len(set(zip(words, words[1:], words[2:])))


def test_long_counts(long_text):
    text = long_text + "\n" + long_text[:500] + "\n" + long_text[:500]
    n, chars, symbols, dup, lines, repeats = quality_rules.text_counts(text)
    words = text.split()
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    assert (n, chars, symbols, dup, lines, repeats) == (len(words), sum(map(len, words)), 0, 1, 3, len(covered))


def test_long_texts_are_labelled_and_scanned(long_text):
    texts = [long_text, "abc", None, long_text + " x"]
    model = langid.Model(["a", "b"], np.random.default_rng(2).random((2, langid.BINS)), np.ones((2, len(langid.SCRIPTS) + 2)), np.ones(2))
    assert list(model.label(texts)) == [next(iter(model.label([t]))) for t in texts]
    index = license_scan.Index(license_scan.TEMPLATES, 100, {})
    words = license_scan.words_of(long_text + " Released under the MIT License. " + long_text)
    assert index.scan(words, set(words)) == pytest.approx({"mit": 1.0})


def test_null_and_empty_tables(spark, sf_dir, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    labels = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_model.classify(docs, labels).collect()} == {0.5}
    assert quality_model.keep_good(docs, docs, labels).count() == docs.count()
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.Mix(mixing.sized_rows(nulls)).taken().count() == 3 and mixing.mix_documents(nulls).count() == 0
    assert quality_rules.judge_quality(nulls).where("not kept").count() == 3 and license_scan.scan_licenses(nulls).count() == 3
    assert {r["lang_pred"] for r in langid.identify(nulls).collect()} == {"und"}
    assert near_dup.near_duplicates(nulls, near_dup.Rule(3, 85)).where("kept").count() == 3 and near_dup.drop_near_duplicates(nulls, near_dup.Rule(3, 85)).count() == 3
    pages = spark.createDataFrame([(None, None, None)] * 3, "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.extract_pages(pages).collect()] == [""] * 3
    assert [r["verdict"] for r in url_filter.filter_urls(pages).collect()] == ["allow"] * 3
    vectors = spark.createDataFrame([(None, None), (20, None), (40, [None])], "vec_id long, embedding array<float>")
    assert ann.neighbours(vectors).count() == 0


def test_stages_keep_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("row", "c", "score", "key", "print", "rid", "words", "parts", "size", "node", "kept", "fa", "component_id", "_lang", "_source", "_print", "path", "n_words", "ids")
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)], F.lit("dot").alias("a.b"), F.lit("tick").alias("c`d"))
    docs = docs.union(docs.limit(5)).union(docs.limit(2).withColumn("text", F.lit("x y z")))  # repeated rows, and ids with a second text
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name
        assert all(r[n] == i for r in out.limit(20).collect() for i, n in enumerate(names)), name
        assert {(r["a.b"], r["c`d"]) for r in out.limit(20).collect()} == {("dot", "tick")}, name
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"] and last.count() == docs.count()
