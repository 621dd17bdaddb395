from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparquill.llm import mixing


def filled(sizes, weights, share, cap):
    """The targets by sharing the excess again and again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, full = [0.0] * len(sizes), set()
    left = share * sum(sizes)
    while left > 1e-9:
        open_ = [i for i in range(len(sizes)) if i not in full]
        if not open_:
            break
        total, given = sum(w[i] for i in open_), left
        left = 0.0
        for i in open_:
            target[i] += given * w[i] / total
            if target[i] >= cap * sizes[i]:
                left += target[i] - cap * sizes[i]
                target[i] = cap * sizes[i]
                full.add(i)
    return target


def test_targets_equal_repeated_sharing(spark):
    for sizes in ([100, 10, 500, 7], [5, 5], [0, 3, 9], [1000, 1, 1, 1, 50, 60]):
        frame = spark.createDataFrame([(f"={i}", f"s{i}", s) for i, s in enumerate(sizes)], "key string, source string, source_size long")
        got = [r["target"] for r in mixing.targets(frame).orderBy("source_no").collect()]
        assert got == pytest.approx(filled(sizes, mixing.WEIGHTS, 1.5, 2))


def test_permutation_is_one(spark):
    n = 1000
    row = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(2)).alias("p"))
    got = [r["p"] for r in row.collect()]
    assert sorted(got) == list(range(n)) and got != list(range(n))


def test_mix_of_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = mixing.Mix(mixing.sized_rows(docs))
    rows = mix.taken().collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by_source = defaultdict(int)
    for r in rows:
        by_source[r["source_size"], r["target"]] += r["taken"]
    for (_, target), taken in by_source.items():
        assert taken == pytest.approx(target, abs=2 * mixing.BLOCK_WORDS + 0.01 * target)
    again = mixing.Mix(mixing.sized_rows(docs.repartition(7))).taken().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    counts = mix.spans.select("shard", "slot").distinct().count()
    assert counts == mix.spans.select("shard", "slot", "block", "source_no", "pass").distinct().count()


def test_messy_rows(spark, messy, nothing):
    rows = mixing.Mix(mixing.sized_rows(messy)).taken().collect()
    assert len(rows) == messy.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.Mix(mixing.sized_rows(nothing)).taken().count() == 0
    out = mixing.mix_documents(messy)
    assert out.columns == messy.columns
    texts = {(r["doc_id"], r["text"]) for r in messy.collect()}
    got = out.collect()
    assert all(any(i == r["doc_id"] and r["text"] in t for i, t in texts if t) or r["doc_id"] == 7 for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert mixing.mix_documents(nothing).count() == 0


def test_taken_equals_a_simulation(spark, sf_dir):
    """Streams, blocks, draws, quotas and passes gone through one by one; only the
    hashed numbers come from Spark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    words, slots = 32, 64
    mix = mixing.Mix(mixing.sized_rows(docs), block_words=words, shard_slots=slots)
    plan = {r["source_no"]: r for r in mix.plan.collect()}
    streams = defaultdict(list)
    for r in mix.documents.orderBy("source_no", "start").collect():
        assert r["start"] == len(streams[r["source_no"]])
        streams[r["source_no"]] += [r["rid"]] * r["size"]
    total = sum(p["quota"] for p in plan.values())
    at = {r["id"]: r["at"] for r in spark.range(total).select("id", mixing.uniform(F.lit(mixing.SEED), "id").alias("at")).collect()}
    drawn = defaultdict(lambda: defaultdict(int))  # source -> shard -> slots
    for slot, u in at.items():
        source = next(s for s, p in plan.items() if p["low"] <= u < p["high"])
        drawn[source][slot // slots] += 1
    numbers, counts = [], defaultdict(int)
    for source, p in plan.items():
        made = sum(drawn[source].values())
        if made < p["quota"]:
            drawn[source][-(-total // slots)] += p["quota"] - made
        got = min(p["quota"], sum(drawn[source].values()))
        assert got == p["quota"] == round(p["target"] * p["n_blocks"] / p["source_size"] if p["source_size"] else 0)
        numbers += [(source, p["n_blocks"], n) for n in range(got)]
    frame = spark.createDataFrame(numbers, "source_no long, n_blocks long, number long")
    key = F.col("number") % F.col("n_blocks")
    blocks = frame.select("source_no", mixing.permuted(key, F.col("n_blocks"), F.lit(mixing.SEED), F.col("source_no"), F.floor(F.col("number") / F.col("n_blocks"))).alias("block"))
    for r in blocks.collect():
        for rid in streams[r["source_no"]][r["block"] * words : (r["block"] + 1) * words]:
            counts[rid] += 1
    got = {r["rid"]: r["taken"] for r in mix.spans.groupBy("rid").agg(F.sum("n_words").alias("taken")).collect()}
    assert got == counts
    per_shard = defaultdict(int)
    for r in mix.spans.select("source_no", "shard", "slot").distinct().collect():
        per_shard[r["source_no"], r["shard"]] += 1
        assert 0 <= r["slot"] < slots or r["shard"] == -(-total // slots)
    left = {s: p["quota"] for s, p in plan.items()}
    for source in drawn:
        for shard in sorted(drawn[source]):
            want = min(left[source], drawn[source][shard])
            left[source] -= want
            assert per_shard.get((source, shard), 0) == want


def test_counts_vary_as_multinomial_ones(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix = mixing.Mix(mixing.sized_rows(docs), block_words=16, shard_slots=256)
    plan = {r["source_no"]: r for r in mix.plan.collect()}
    last = mix.n_slots // 256
    squares, expected = 0.0, 0.0
    counts = {(r["source_no"], r["shard"]): r["drawn"] for r in mix._drawn(mixing.SEED, 256).where(F.col("shard") < last).collect()}
    for source, p in plan.items():
        share = p["high"] - p["low"]
        for shard in range(last):
            squares += (counts.get((source, shard), 0) - 256 * share) ** 2
            expected += 256 * share * (1 - share)
    assert 0.9 < squares / expected < 1.1


def test_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i % 3, text if i % 2 else text + " more", "s", 1, {"k": i}) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rid int, print map<string,int>")
    out = mixing.mix_documents(docs)
    taken = sum(len(r["text"].split()) for r in out.collect())
    size = sum(len(t.split()) for _, t, *_ in rows)
    assert out.columns == docs.columns and taken == pytest.approx(1.5 * size, abs=2 * mixing.BLOCK_WORDS)
