"""Many patterns against each alone; blocks; 100,000 names in one pass."""

import random
import re
import time

from pyspark.sql import functions as F

from sparquill.operators import packs, patterns


def test_equals_each_pattern_alone(spark):
    random_ = random.Random(2)
    texts = ["".join(random_.choices("ab_ é日1", k=random_.randint(0, 30))) for _ in range(120)] + [None, ""]
    wanted = sorted({"".join(random_.choices("ab_é日1", k=random_.randint(1, 4))) for _ in range(60)})
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k long, text string, n_words string")
    table = spark.createDataFrame([(p,) for p in [*wanted, wanted[0], "", None]], "pattern string")
    for whole in (False, True):
        want = {}
        for i, t in enumerate(texts):
            for p in wanted:
                guard = rf"(?<![A-Za-z0-9_])(?={re.escape(p)}(?![A-Za-z0-9_]))" if whole else rf"(?={re.escape(p)})"
                if n := len(re.findall(guard, t or "")):
                    want[i, p] = n
        for largest in (None, 40):
            got = patterns.occurrences(rows, table, whole_words=whole, largest=largest)
            assert got.columns == ["k", "text", "n_words", "pattern", "n"]
            assert {(r["k"], r["pattern"]): r["n"] for r in got.collect()} == want
    assert len(list(patterns.blocks(table, 40))) > 2
    assert patterns.occurrences(rows, table.limit(0)).count() == 0 and patterns.occurrences(rows.limit(0), table).count() == 0


def test_a_hundred_thousand_names_in_one_pass(spark):
    names = spark.range(100_000).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("name"))
    lines = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("line"), F.concat(F.lit("a line with name"), (F.col("id") * 7).cast("string"), F.lit(" and name3x in it")).alias("text"))
    began = time.time()
    found = packs.co_mentions(lines, names, "k")
    assert found.count() == sum(i * 7 < 100_000 for i in range(20_000))
    assert found.where("name <> concat('name', k * 7)").count() == 0 and time.time() - began < 60


def test_texts_need_not_come_back(spark):
    rows = spark.createDataFrame([(i, "ab abc") for i in range(2500)], "k long, text string").coalesce(1)
    names = spark.createDataFrame([("ab",), ("abc",)], "pattern string")
    lean, whole = (patterns.occurrences(rows, names, with_text=w) for w in (False, True))
    assert lean.columns == ["k", "pattern", "n"] and sorted(lean.collect()) == sorted(whole.drop("text").collect()) and lean.count() == 5000
    assert patterns.occurrences(rows, names.limit(0), with_text=False).columns == lean.columns
