"""Title state: checked addresses, merges that repeat, partitions that stay, index files."""

import json
import os

import pytest

from sparquill.operators import titles

BASE = "https://w.example/wiki/"
RAW = [  # address, page: in the order of seeing
    ("https://w.example/wiki/d/%A4%A2?k=1", "p1"), ("https://w.example/wiki/d/a%7Eb", "p2"), ("https://w.example/wiki/d/%a4%a2#x", "p3"), ("https://w.example/wiki/d/a~b", "p4"),
    ("https://w.example/wiki/d/%A4%A2", "p5"), ("https://w.example/other/d/x", "p6"), ("http://w.example/wiki/d/x", "p7"), ("https://w.example/wiki/x", "p8"),
    ("https://w.example/wiki/d/%FF", "p9"), ("https://w.example/wiki/d/" + "x" * 1100, "p10"), ("https://w.example/wiki/d/c?q", "p11"), (None, "p12"), ("https://w.example/wiki/d/c?r", None),
]


def seen_of(spark, rows, start=0):
    frame = spark.createDataFrame([(u, p, start + i) for i, (u, p) in enumerate(rows)], "url string, observed_on string, n long")
    return titles.observations(frame, BASE, ["n"])


def state_of(frame):
    return {r["title"]: (r["url"], r["title_encoding"], r["observed_on"], r["url_source"], r["observed_urls"]) for r in frame.collect()}


WANT = {
    "あ": ("https://w.example/wiki/d/%a4%a2", "euc_jp", "p3", "observed_url", ["https://w.example/wiki/d/%A4%A2?k=1", "https://w.example/wiki/d/%a4%a2"]),
    "a~b": ("https://w.example/wiki/d/a%7Eb", "euc_jp", "p2", "observed_url", ["https://w.example/wiki/d/a%7Eb", "https://w.example/wiki/d/a~b"]),
    "c": ("https://w.example/wiki/d/c", "euc_jp", "p11", "query_removed_from_observed_url", ["https://w.example/wiki/d/c?q", "https://w.example/wiki/d/c?r"]),
}


def test_articles_merge_by_identity(spark):
    got = state_of(titles.merged(seen_of(spark, RAW)))
    assert got == WANT


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_merging_again_changes_no_file(spark, tmp_path):
    path = str(tmp_path / "state")
    assert titles.load(spark, path).count() == 0
    first = titles.merge_into(spark, path, seen_of(spark, RAW), buckets=4)
    before, state = files_of(path), state_of(titles.load(spark, path))
    assert first and titles.merge_into(spark, path, seen_of(spark, RAW), buckets=4) == [] and files_of(path) == before
    more = [("https://w.example/wiki/d/c", "p20"), ("https://w.example/wiki/d/new", "p21")]
    changed = titles.merge_into(spark, path, seen_of(spark, more, 100), buckets=4)
    after = state_of(titles.load(spark, path))
    assert after["c"] == ("https://w.example/wiki/d/c", "euc_jp", "p20", "observed_url", [*WANT["c"][4], "https://w.example/wiki/d/c"])
    assert {t: v for t, v in after.items() if t in ("あ", "a~b")} == {t: v for t, v in state.items() if t in ("あ", "a~b")} and "new" in after
    untouched = {f for f in before if not any(f"bucket={b}/" in f for b in changed)}
    assert untouched <= set(files_of(path))
    together = titles.merged(seen_of(spark, RAW + [(None, None)] * (100 - len(RAW)) + more))
    assert state_of(together) == after


def test_index_files_are_read_as_written(spark, tmp_path):
    path = str(tmp_path / "state")
    titles.merge_into(spark, path, seen_of(spark, RAW), buckets=4)
    state = titles.load(spark, path)
    assert titles.write_index(state, "wiki", str(tmp_path / "index")) is None
    seen, errors = titles.read_index(spark, str(tmp_path / "index" / "part-*"), BASE)
    assert [r["error"] for r in errors.collect()] == [None]
    assert state_of(titles.merged(seen)) == state_of(state)
    assert titles.merge_into(spark, path, seen, buckets=4) == []
    assert titles.write_index(state, "wiki", str(tmp_path / "index"), largest=200) == "index_too_large"
    assert titles.read_index(spark, str(tmp_path / "index" / "part-*"), BASE)[0].count() == 6  # what was there stays
    assert titles.as_index(state, "wiki", largest=10).first()["entries"] == []


@pytest.mark.parametrize(("change", "error"), [
    ({}, None), ({"schema": 3}, "schema"), ({"wiki": "other"}, "other_wiki"), ({"entries": None}, "not_json"), ("{broken", "not_json"),
    ({"title": "b"}, "mismatch"), ({"url": "https://w.example/wiki/d/b"}, "mismatch"), ({"observed_urls": ["https://w.example/wiki/d/b"]}, "mismatch"),
    ({"observed_urls": []}, "entry"), ({"title": None}, "entry"), ({"url": "https://w.example/wiki/d/a?x"}, "query"), ({"observed_urls": ["https://v.example/wiki/d/a"]}, "mismatch"),
])
def test_index_files_with_anything_wrong_give_nothing(spark, tmp_path, change, error):
    entry = {"title": "a", "url": "https://w.example/wiki/d/a", "title_encoding": "euc_jp", "observed_on": "p", "url_source": "observed_url", "observed_urls": ["https://w.example/wiki/d/a"]}
    good = {**entry, "title": "z", "url": "https://w.example/wiki/d/z", "observed_urls": ["https://w.example/wiki/d/z?q", "https://w.example/wiki/d/z"]}
    index = {"schema": 2, "wiki": "wiki", "entries": [good, entry]}
    if isinstance(change, dict):
        for k, v in change.items():
            (index if k in index else entry)[k] = v
    (tmp_path / "one.json").write_text(change if isinstance(change, str) else json.dumps(index))
    (tmp_path / "two.json").write_text(json.dumps({"schema": 1, "entries": [{"title": "o", "url": "https://w.example/wiki/d/o?x"}]}))
    seen, errors = titles.read_index(spark, str(tmp_path / "*.json"), BASE)
    assert {os.path.basename(r["path"]): r["error"] for r in errors.collect()} == {"one.json": error, "two.json": None}
    assert set(state_of(titles.merged(seen))) == ({"o"} if error else {"o", "a", "z"})
