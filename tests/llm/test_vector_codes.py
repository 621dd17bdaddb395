"""Vector codes against a plain version, DuckDB, and hard values."""

import hashlib
import math

import duckdb
import numpy as np

from sparquill.llm import vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) with Python integers, for vectors of one length."""
    kept = [(i, label, [math.floor(256 * x) if abs(x) < 2**40 else 256 * int(x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, _, v in kept:
                part = v[p * width : (p + 1) * width]
                members.setdefault(nearest(part, book)[1], []).append(part)
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    coded, per_label = [], {}
    for i, label, v in kept:
        best = [nearest(v[p * width : (p + 1) * width], book) for p, book in enumerate(books)]
        coded.append((i, label, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), vector_codes.LARGEST)))
        per_label[label] = per_label.get(label, 0) + coded[-1][3]
    return sorted(((i, c, e, min(per_label[label], vector_codes.LARGEST), digest) for i, label, c, e in coded), key=repr)


def run(frame, **how):
    return sorted(map(tuple, vector_codes.compress(frame, **how).collect()), key=repr)


def test_codes_equal_a_plain_version(spark):
    random_ = np.random.default_rng(4)
    rows = [(i, int(i) % 3 if i % 7 else None, random_.normal(size=32).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, 1, rows[3][2]) for i in range(40)]  # repeated vectors and ids
    rows += [(None, 2, rows[5][2]), (900, 1, None), (901, 1, [None] * 32), (902, 1, [math.nan] * 32), (903, 1, [math.inf] + [0.0] * 31)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<float>, code string, kind string").repartition(5)
    assert run(frame) == brute(rows)
    few = spark.createDataFrame(rows[:9], "vec_id long, label int, embedding array<float>")
    assert run(few) == brute(rows[:9])
    assert run(few.limit(0)) == []
    assert run(frame.coalesce(1)) == run(frame.repartition(11))


def test_components_of_any_size(spark):
    random_ = np.random.default_rng(5)
    rows = [(i, 0, (random_.normal(size=16) * 10.0 ** (i % 12)).tolist()) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    assert run(frame) == brute(rows)
    huge = spark.createDataFrame([(1, 0, [1e300] * 16), (2, 0, [-1e300] * 16), (3, 1, [0.5] * 16)], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r for r in vector_codes.compress(huge, entries=1, rounds=0).collect()}
    assert got[1]["error"] == 0 and got[2]["error"] == got[2]["label_error"] == vector_codes.LARGEST


def test_lengths_have_their_own_codebooks(spark):
    rows = [(i, 0, [float(i)] * n) for n in (16, 32, 20, 3, 0) for i in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = vector_codes.compress(frame).collect()
    assert len(got) == 20 and len({r["codebooks_sha256"] for r in got}) == 5 and {r["error"] for r in got} == {0}
    assert {r["code"] for r in got if r["vec_id"] == 1} == {"01" * 16, "".join("01" if 3 * p // 16 < 3 * (p + 1) // 16 else "00" for p in range(16)), "00" * 16}
    assert run(frame.where("size(embedding) = 16").drop("label")) == run(frame.where("size(embedding) = 16").withColumn("label", frame.vec_id * 0))


def test_equals_sql(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    result = db.execute(vector_codes.oracle())
    names = [c[0] for c in result.description]
    assert names == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(result.fetchall(), key=repr) == run(frame)
