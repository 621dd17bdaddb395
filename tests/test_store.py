"""The store of responses: what is written comes back, what is unsound does not, labels are not trusted."""

import pytest
from pyspark.sql import functions as F

from sparquill.sources import snapshots, store

PAGE = "<html><body><div id=page-body-inner><div class=user-area><h1>T</h1>text é</div></div></body></html>"
URL = "https://w.example/wiki/d/%A4%A2"
def now():
    return F.lit(100_000).cast("timestamp")


def response(spark, rows):
    """rows: url, user agent, body, metadata changes, overridden."""
    kinds = {f.name: f.dataType for f in snapshots.METADATA}
    whole = [(u, a, bytearray(b), {"requested_url": u, "url": u, "http_status": 200, "content_type": "text/html; charset=utf-8", "fetched_at": "2024", **change}, over) for u, a, b, change, over in rows]
    fields = [(u, a, b, tuple(m.get(k) for k in kinds), over) for u, a, b, m, over in whole]
    return spark.createDataFrame(fields, f"requested_url string, requested_user_agent string, raw binary, metadata {snapshots.METADATA.simpleString()}, overridden boolean")


def one(spark, path, body=PAGE.encode(), change=None, over=False, policy="clean"):
    return [r["code"] for r in store.store(response(spark, [(URL, "a", body, change or {}, over)]), path, "v", now(), policy).collect()]


def test_what_is_stored_comes_back(spark, tmp_path):
    path = str(tmp_path / "s")
    assert one(spark, path) == []
    records = spark.read.schema(snapshots.RECORD).parquet(path)
    asked = spark.createDataFrame([(URL, "a"), (URL.replace("%A4", "%a4") + "#x", "a"), (URL, "b"), (URL + "?k=1", "a"), (None, "a")], "url string, user_agent string")
    got = {(r["url"], r["user_agent"]): r for r in store.load(asked, records, "v", now()).collect()}
    assert got[URL, "a"]["code"] is None and got[URL, "a"]["quality"] == "clean" and got[URL, "a"]["age"] == 0
    again = got[URL.replace("%A4", "%a4") + "#x", "a"]
    assert again["record"]["sha256"] == got[URL, "a"]["record"]["sha256"]
    assert [got[k]["code"] for k in ((URL, "b"), (URL + "?k=1", "a"), (None, "a"))] == ["not_stored"] * 3
    late = F.lit(100_000 + snapshots.TTL_SECONDS + 1).cast("timestamp")
    assert {r["code"] for r in store.load(asked.limit(1), records, "v", late).collect()} == {"expired"}
    assert {r["code"] for r in store.load(asked.limit(1), records, "w", now()).collect()} == {"version"}
    newer = records.withColumn("stored_at", F.col("stored_at") - 50).union(records.withColumn("sha256", F.lit("0" * 64)))
    best = store.load(asked.limit(1), newer, "v", now()).first()
    assert best["code"] is None and best["age"] == 50  # the newest is damaged, so the one before it counts


@pytest.mark.parametrize(("body", "change", "code"), [
    (PAGE.encode(), {"http_status": 404}, "status"), (PAGE.encode(), {"requested_url": "https://w.example/wiki/d/b"}, "identity"), (PAGE.encode(), {"url": "https://w.example/x/d/b"}, "scope"),
    (PAGE.encode(), {"fetched_at": None}, "source"), (PAGE.encode(), {"content_type": None}, "source"), (PAGE.encode(), {"content_type": "image/png"}, "not_html"), (b"plain", {"content_type": ""}, "not_html"),
    (b"<link rel=s href=/css/wiki/lite/a.css><body>lite", {}, "mobile_layout"), (b"<html><body>no article", {}, "incomplete"), (PAGE.replace("</div></div>", "").encode(), {}, "incomplete"),
    (PAGE.encode().replace(b"\xc3\xa9", b"\xff"), {}, "content_diagnostics"), (PAGE.replace("é", "&#xD83D;&#xDE00;").encode(), {}, "content_diagnostics"), (PAGE.replace("T<", "�<").encode(), {}, "content_diagnostics"),
])
def test_refusals_have_codes(spark, tmp_path, body, change, code):
    assert one(spark, str(tmp_path / "s"), body, change) == [code]
    assert spark.read.schema(snapshots.RECORD).parquet(str(tmp_path / "s")).count() == 0


def test_policies_and_overrides(spark, tmp_path):
    damaged = PAGE.encode().replace(b"\xc3\xa9", b"\xff")
    path = str(tmp_path / "s")
    assert one(spark, path, over=True) == ["explicit_override"]
    assert one(spark, path, damaged, policy="diagnostic") == []
    records = spark.read.schema(snapshots.RECORD).parquet(path).withColumn("quality", F.lit("clean"))  # a label that is wrong
    asked = spark.createDataFrame([(URL, "a")], "url string, user_agent string")
    got = store.load(asked, records, "v", now(), policy="diagnostic").first()
    assert got["quality"] == "diagnostic" and got["reasons"] == ["byte_decode_replacements", "article_replacements", "structured_replacements"]
    assert store.load(asked, records, "v", now()).first()["code"] == "content_diagnostics"
    with pytest.raises(ValueError):
        store.judged(records, "v", now(), policy="any")
    assert store.load(asked, records.limit(0), "v", now()).first()["code"] == "not_stored"


def test_bytes_of_every_width(spark):
    lite = "<LINK rel='x>y' href=\"/css/wiki&#47;lite/a.css\"><p>x"
    bodies = [
        (PAGE.encode("utf-16"), "text/html", True, False), (PAGE.encode("utf-32"), None, True, False), (PAGE.encode("utf-16-le"), "text/html; charset=UTF-16LE", True, False), (b"no markup", "", False, False),
        (lite.encode(), None, False, True), (lite.encode("utf-16"), None, False, True), (lite.replace("<p>", "<div id='page-body-inner'>").encode(), None, True, False), (lite.replace("lite", "full").encode(), None, False, False), (None, None, False, False),
    ]
    frame = spark.createDataFrame([(i, bytearray(b) if b is not None else None, c) for i, (b, c, _, _) in enumerate(bodies)], "i int, raw binary, kind string")
    got = frame.select("i", store.html_evidence(F.col("raw"), F.col("kind")).alias("html"), store.mobile_layout(F.col("raw"), F.col("kind")).alias("mobile")).orderBy("i").collect()
    assert [(r["html"], r["mobile"]) for r in got] == [(h, m) for _, _, h, m in bodies]
