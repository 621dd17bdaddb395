import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from test_near_dup import components
from test_text_models import exact_verdicts

import corpus_pipeline
from sparquill.llm import bpe, catalog, mixing, quality_model, quality_rules


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        docs = after
    assert 0 < docs.count() < before
    mixed = corpus_pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    last = corpus_pipeline.encode(spark, mixed, sf_dir).collect()
    assert last and all(r["round_trip"] for r in last)


def test_messy_and_empty(spark, messy, nothing, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, messy, sf_dir).columns == messy.columns, name
        assert stage(spark, nothing, sf_dir).count() == 0, name
    rows = corpus_pipeline.encode(spark, messy, sf_dir).collect()
    assert len(rows) == messy.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["ids"] == [] for r in rows if r["doc_id"] in (2, 3)) and corpus_pipeline.encode(spark, nothing, sf_dir).count() == 0


def test_run_equals_the_stages_by_hand(spark, sf_dir):
    """Every document's way through all five stages: verdicts from exact quantiles,
    votes, groups from all pairs of sets, the mix's totals, the public library's ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}
    judged = quality_rules.judge_quality(docs).collect()
    good = {r["doc_id"] for r, (want, close) in zip(judged, exact_verdicts(judged), strict=True) if (r["kept"] if close else want)}
    scores = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, labels).collect()}
    good = {i for i in good if scores[i] >= 0.5}
    group = components([(i, texts[i]["text"]) for i in sorted(good)], corpus_pipeline.NEAR)
    kept = {i for i in good if group[i] == i}
    assert kept < good < set(texts)

    with open(public_tokenizers.path(catalog.VOCABULARY), "rb") as f:
        ranks = bpe.Vocabulary.parse(f.read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = {i: re.findall(mixing.WORD, texts[i]["text"]) for i in kept}
    taken, by_source = Counter(), Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        text = library.decode(r["ids"])
        assert r["doc_id"] in kept and r["ids"] == library.encode_ordinary(text) and r["round_trip"] and r["n_tokens"] == len(r["ids"])
        some = re.findall(mixing.WORD, text)
        assert not Counter(some) - Counter(words[r["doc_id"]])
        taken[r["doc_id"]] += len(some)
        by_source[r["source"]] += len(some)
    assert all(n <= 2 * len(words[i]) for i, n in taken.items())
    sizes = Counter()
    for i in kept:
        sizes[texts[i]["source"]] += len(words[i])
    frame = spark.createDataFrame([(f"={s}", s, n) for s, n in sizes.items()], "key string, source string, source_size long")
    for r in mixing.targets(frame).collect():
        assert by_source[r["key"][1:]] == pytest.approx(r["target"], abs=2 * mixing.BLOCK_WORDS)


def test_each_stage_holds_its_batches_small(spark, nothing, sf_dir):
    """Also in a session of its own, where no stage ran before."""
    for name, stage in corpus_pipeline.STAGES:
        own = spark.newSession()
        stage(own, own.createDataFrame([], nothing.schema), sf_dir)
        assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20), name
