"""Story plans: ceilings, tiers that do not fit, raised members, reading in parts."""

import random
import tracemalloc

import pytest

from sparquill.operators import lines, packs, stories

SIZES = {"cameo": 10, "brief": 20, "normal": 40, "full": 80, "ace": 160}
PAIRS = {"names": 1, "brief": 5, "normal": 10, "full": 20, "ace": 40}


def tables(spark, limits, members=4, extra=0):
    cast = spark.createDataFrame([(p, f"m{i}", i, limit) for p, limit in limits.items() for i in range(1, members + 1)], "pack string, name string, place long, limit long")
    sizes = spark.createDataFrame([(f"m{i}", d, n * i) for i in range(1, members + 1) for d, n in SIZES.items()], "name string, detail string, size long")
    pairs = spark.createDataFrame([(f"m{i}", f"m{j}", d, n) for i in range(1, members + 1) for j in range(i + 1, members + 1) for d, n in PAIRS.items()], "src string, dst string, detail string, size long")
    extras = spark.createDataFrame([(f"m{i}", extra) for i in range(1, members + 1)], "name string, size long")
    return cast, sizes, pairs, extras


def by_hand(limit, members, extra, ceiling=None):
    order = list(SIZES)
    top = order.index(ceiling) + 1 if ceiling else 5
    n_pairs, fixed = members * (members - 1) // 2, extra * members
    tiers = [(n, i, p) for n, (i, p) in enumerate(packs.TIERS, 1) if order.index(i) < top and (p == "names" or order.index(p) < top)]
    total = lambda i, p: sum(SIZES[i] * k for k in range(1, members + 1)) + PAIRS[p] * n_pairs + fixed
    fitting = [t for t in tiers if total(*t[1:]) <= limit]
    tier, item, pair = (fitting[0] if fitting else (99, *min(tiers, key=lambda t: (total(*t[1:]), t[0]))[1:]))
    level, left = [order.index(item)] * members, limit - total(item, pair)
    raised = tier != 99
    while raised:
        raised = False
        for k in range(members):
            if level[k] + 1 < top and (SIZES[order[level[k] + 1]] - SIZES[order[level[k]]]) * (k + 1) <= left:
                left -= (SIZES[order[level[k] + 1]] - SIZES[order[level[k]]]) * (k + 1)
                level[k] += 1
                raised = True
    size = sum(SIZES[order[x]] * (k + 1) for k, x in enumerate(level)) + PAIRS[pair] * n_pairs + fixed
    return tier, pair, size, [order[x] for x in level]


@pytest.mark.parametrize("ceiling", [None, "ace", "full", "normal", "brief"])
def test_plans_equal_those_by_hand(spark, ceiling):
    random_ = random.Random(1)
    limits = {f"p{i}": random_.randint(50, 2200) for i in range(25)} | {"none": 10, "all": 10_000}
    cast, sizes, pairs, extras = tables(spark, limits, extra=7)
    got = {}
    for r in stories.plan(cast, sizes, pairs, extras, ceiling).orderBy("pack", "place").collect():
        got.setdefault(r["pack"], (r["tier"], r["pair_detail"], r["size"], []))[3].append(r["detail"])
    assert got == {p: by_hand(limit, 4, 7, ceiling) for p, limit in limits.items()}
    assert got["none"][0] == 99 and got["all"][3] == [ceiling or "ace"] * 4
    assert any(len(set(g[3])) > 1 for g in got.values())  # some packs have room for some members only


def test_automatic_limit_and_members_without_texts(spark):
    cast = spark.createDataFrame([("a", "x", 1, None), ("a", "y", 2, None), ("b", "gone", 1, None)], "pack string, name string, place long, limit long")
    sizes = spark.createDataFrame([("x", "ace", 5), ("x", "cameo", 2)], "name string, detail string, size long")
    none = spark.createDataFrame([], "src string, dst string, detail string, size long")
    rows = {(r["pack"], r["name"]): r for r in stories.plan(cast, sizes, none).collect()}
    assert {k: (r["limit"], r["tier"], r["detail"]) for k, r in rows.items()} == {
        ("a", "x"): (135_000, 1, "ace"), ("a", "y"): (135_000, 1, "ace"), ("b", "gone"): (120_000, 1, "ace")}
    items = spark.createDataFrame([("x", "ace", "hello"), ("x", "cameo", "he")], "name string, detail string, text string")
    pairs = spark.createDataFrame([("y", "x", "ace", "y of x"), ("x", "z", "ace", "not in the cast"), ("x", "y", "brief", "less")], "src string, dst string, detail string, text string")
    extras = spark.createDataFrame([("x", "topic", 2, "t2"), ("x", "topic", 1, "t1"), ("y", "reaction", 1, "r")], "name string, kind string, line long, text string")
    planned = stories.plan(cast, sizes, none)
    told = stories.write(planned, items, pairs, extras).orderBy("pack", "place").collect()
    assert [(r["place"], r["kind"], r["name"], r["other"], r["text"]) for r in told] == [
        (1, "item", "x", None, "hello"), (2, "topic", "x", None, "t1"), (3, "topic", "x", None, "t2"), (4, "reaction", "y", None, "r"), (5, "pair", "y", "x", "y of x")]
    assert stories.view(planned).where("pack = 'a'").first()["text"] == "- x: ace\n- y: ace\npairs (1): ace\ncharacters: 5 of 135000"
    empty = spark.createDataFrame([], "pack string, name string, place long, limit long")
    assert stories.plan(empty, sizes, none).count() == 0


def test_parts_have_frames(spark):
    text = "\n".join("x" * 40 for _ in range(100))
    rows = stories.framed_parts(spark.createDataFrame([("p", text), ("q", "short"), ("n", None)], "pack string, text string"), "pack", limit=900).orderBy("pack", "part").collect()
    long = [r for r in rows if r["pack"] == "p"]
    assert "\n".join(r["body"] for r in long) == text and len(long) == long[0]["parts"] == 5 and all(len(r["body"]) <= 900 for r in long)
    assert long[0]["header"] == "part 1 of 5:" and long[0]["footer"] == "part 1 of 5 ends here; part 2 follows" and long[-1]["footer"] == "part 5 of 5 ends here; it is the last"
    assert [r["body"] for r in rows if r["pack"] == "q"] == ["short"] and not [r for r in rows if r["pack"] == "n"]


def test_texts_are_not_read_for_a_plan(spark):
    """Sizes come from their own columns; the plan's shuffles carry no text."""
    cast, sizes, pairs, extras = tables(spark, {"p": 500})
    plan = stories.plan(cast, sizes, pairs, extras)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


def test_long_packs_are_cut_and_raised_in_little_memory(spark):
    def plain(text, limit):
        bodies, size = [], 0
        for line in text.split("\n"):
            if bodies and size + 1 + len(line) <= limit:
                bodies[-1].append(line)
                size += 1 + len(line)
            else:
                bodies.append([line])
                size = len(line)
        return ["\n".join(b) for b in bodies]

    random_ = random.Random(7)
    for _ in range(3000):
        text = "".join(random_.choices("aé\n", weights=(3, 1, random_.choice((1, 4))), k=random_.randint(0, 30)))
        limit = random_.randint(-1, 12)
        assert lines.cut_lines(text, limit) == plain(text, limit), (text, limit)
    text = "a line of a pack\n" * 200_000
    tracemalloc.start()
    bodies = lines.cut_lines(text, 15_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "\n".join(bodies) == text and peak < 1.5 * len(text)

    def raised(rows, limit):
        level, left = [r[1] for r in rows], limit - sum(r[2][r[1]] for r in rows)
        while True:
            before = list(level)
            for i, (_, _, sizes) in enumerate(rows):
                if level[i] + 1 < len(sizes) and sizes[level[i] + 1] - sizes[level[i]] <= left:
                    left -= sizes[level[i] + 1] - sizes[level[i]]
                    level[i] += 1
            if level == before:
                return {r[0]: x for r, x in zip(rows, level, strict=True)}

    packs_ = {k: ([(f"{k}-{i}", random_.randint(0, 1), sorted(random_.choices(range(60), k=random_.randint(2, 5)))) for i in range(n)], 40 * n) for k, n in ((1, 1), (2, 300), (3, 9000))}
    rows = [(k, i, name, level, limit, sizes) for k, (members, limit) in packs_.items() for i, (name, level, sizes) in enumerate(members)]
    random_.shuffle(rows)
    got = packs.upgrade(spark.createDataFrame(rows, "k long, ord int, item string, level int, limit long, sizes array<long>"), "k").collect()
    assert {r["item"]: r["level"] for r in got} == {name: x for members, limit in packs_.values() for name, x in raised(members, limit).items()}
