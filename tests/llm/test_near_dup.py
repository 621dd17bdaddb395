import random

import numpy as np
import pytest

from sparquill.llm import near_dup

RULE = near_dup.Rule(3, 85)


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def components(rows, rule):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, rule.words)) for i, t in rows if i is not None]
    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= rule.percent * len(s | t):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in parent}


def test_bands_seldom_miss():
    for percent in (80, 85, 95):
        rows, bands = near_dup.Rule(3, percent).bands()
        assert (1 - (percent / 100) ** rows) ** bands <= near_dup.MISS and rows * bands <= near_dup.SAMPLES


def test_odd_sketch_estimates():
    sketcher = near_dup.Sketcher(RULE)
    random_ = np.random.default_rng(1)
    a = random_.integers(0, 1 << 63, 1000, np.uint64)
    b = np.concatenate([a[:900], random_.integers(0, 1 << 63, 100, np.uint64)])
    x, y = (sketcher.parity(sketcher.samples(np.unique(s))).view(np.uint64) for s in (a, b))
    differ = int(np.bitwise_count(x ^ y).sum())
    estimate = 1 + near_dup.SKETCH_BITS / (4 * near_dup.SAMPLES) * np.log(1 - 2 * differ / near_dup.SKETCH_BITS)
    assert estimate == pytest.approx(900 / 1100, abs=near_dup.MARGIN)


def test_groups_equal_brute_force(spark):
    random_ = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        words = random_.choices(vocabulary, k=60 + 10 * group)
        for _ in range(8):
            copy = words[:]
            for _ in range(random_.randint(0, 4)):
                copy[random_.randrange(len(copy))] = random_.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    chain = random_.choices(vocabulary, k=120)  # each a near copy of the one before only
    for step in range(10):
        chain[step * 4] = f"new{step}"
        rows.append((len(rows), " ".join(chain)))
    random_.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs, RULE).collect()}
    want = components(rows, RULE)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingles(t, 3)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_messy_rows(spark, messy, nothing):
    rows = [tuple(r) for r in near_dup.near_duplicates(messy, RULE).orderBy("doc_id").collect()]
    assert rows[0] == (None, 1, None, True)
    assert [r for r in rows if r[0] in (8, 9)] == [(8, 1, 8, True), (9, 1, 8, False), (9, 1, 8, False)]
    assert [r for r in rows if r[0] in (2, 3, 4)] == [(i, 0, i, True) for i in (2, 3, 4)]
    kept = near_dup.drop_near_duplicates(messy, RULE)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 2
    assert near_dup.near_duplicates(nothing, RULE).count() == 0 and near_dup.drop_near_duplicates(nothing, RULE).count() == 0


def test_repeated_id_drops_its_near_copy_only(spark):
    text, other = (" ".join(f"{w}{i}" for i in range(200)) for w in "ab")
    rows = [(1, text), (5, other), (5, text + " end"), (6, other + " end"), (None, text), (7, "")]
    kept = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), RULE).collect()
    assert {tuple(r) for r in kept} == {(1, text), (5, other), (None, text), (7, "")} and len(kept) == 4


def test_one_row_of_a_group_stays(spark):
    """Rows that share a doc_id, in one group or in two that are named alike."""
    text, other = (" ".join(f"{w}{i}" for i in range(200)) for w in "ab")
    rows = [(5, text), (5, text + " end"), (5, text + "  end"), (5, other), (7, other + " end"), (8, text), (9, None), (9, " ")]
    kept = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), RULE).collect()
    assert [r["doc_id"] for r in kept].count(5) == 2 and {r["doc_id"] for r in kept} == {5, 9} and (5, other) in {tuple(r) for r in kept}
    assert [r["doc_id"] for r in kept].count(9) == 1
