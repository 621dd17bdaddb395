"""Ranked search against plain scores of every pair, DuckDB, and bounds."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from sparquill.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(docs, items, k=20):
    return sorted(map(tuple, lexical_search.search(docs, items, k).collect()), key=repr)


def test_search_equals_brute_force(spark, messy, nothing):
    random_ = random.Random(3)
    words = [*"alpha beta gamma DELTA épée ÉPÉE 日本 x1 22 _".split(), "a-b"]
    docs = [(i, " ".join(random_.choices(words, k=random_.randint(0, 40)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(60)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (500, ""), (501, "alpha " * 40_000)]
    items = [(1, "alpha gamma gamma x1"), (2, docs[7][1]), (2, "beta"), (3, None), (4, "unknown"), (5, ""), (6, "Épée épée 日本"), (1, "alpha gamma gamma x1"), (None, "22")]
    doc_frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, score int, term string").repartition(7)
    item_frame = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int").repartition(3)
    assert run(doc_frame, item_frame) == brute(docs, items)
    assert run(doc_frame, item_frame, 3) == brute(docs, items, 3)
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert run(messy, messy.withColumnRenamed("doc_id", "item_id")) == brute(rows, rows)
    assert run(nothing, item_frame) == [] and run(doc_frame, item_frame.limit(0)) == []


def test_items_in_several_blocks(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 11} w{i % 13} common") for i in range(200)]
    items = [(i, f"w{i} common w{i + 1}") for i in range(12)]
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 60)
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    assert len(lexical_search.item_blocks(item_frame)) > 2
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), item_frame) == brute(docs, items)


def test_bounds_hold_every_score():
    random_ = np.random.default_rng(2)
    tf, sizes = random_.integers(1, 50, 5000), random_.integers(50, 100_000, 5000)
    m = lexical_search.norms(sizes, 5000, int(sizes.sum()))
    exact = lexical_search.impacts(tf, m)
    steps = -(-exact // lexical_search.STEP)
    assert steps.max() <= 255 and (lexical_search.STEP * steps >= exact).all()
    assert (lexical_search.STEP * steps - (lexical_search.STEP - 1) <= exact).all()
    huge = np.array([1 << 40, 3])
    assert lexical_search.norms(huge, 1 << 30, 1 << 45).tolist() == [75 + 25 * int(n) * (1 << 30) // (1 << 45) for n in huge]


def test_few_documents_are_scored_exactly():
    """Bounds leave out most documents, and copies of the best do not hide the smallest id."""
    random_ = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(random_.choices(vocabulary, k=60))) for i in range(3000)]
    items = [(i, docs[i * 5][1]) for i in range(10)]
    block = lexical_search.Block([(i, t.encode()) for i, t in items])
    n_docs, n_terms, chunk = lexical_search.Chunk.of([i for i, _ in docs], [t.encode() for _, t in docs], block.terms)
    df = np.diff(chunk.starts)
    weights = np.zeros(len(block.terms), np.int64)
    weights[chunk.terms] = [lexical_search.weight(n_docs, int(n)) for n in df]
    chunk.impact = chunk.quantised(n_docs, n_terms)
    searcher = lexical_search.Searcher(block, weights, n_docs, n_terms, 20)
    searcher.look_up(chunk)
    assert searcher.rescored < 10 * 60
    got = [(items[i][0], rank, int(d), int(s)) for i, b in enumerate(searcher.best) for rank, (d, s) in enumerate(zip(b.ids, b.scores, strict=True), 1)]
    assert sorted(got, key=repr) == brute(docs, items)


def test_equals_sql(spark, sf_dir):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    result = db.execute(lexical_search.oracle())
    assert [c[0] for c in result.description] == ["item_id", "rank", "doc_id", "score"]
    assert sorted(result.fetchall(), key=repr) == run(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark")))
