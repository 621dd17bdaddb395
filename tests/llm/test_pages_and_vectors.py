import math
import re

import numpy as np
import pytest

from sparquill.llm import ann, html_extract, url_filter


def test_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><div class='sidebar'>side</div>"
        "<div class='content{n}'><h1>Head &amp; more</h1><p>one\n two<br>three<p><b>unclosed<p>four &lt;x&gt; <script>var t='</p>';</script></div>"
        "<div id='comments'><p>a reader's very long comment that says a lot, and even more than the article, on and on and on</p></div><footer>foot</footer>"
    )
    want = "Head & more\n\none two three\n\nunclosed\n\nfour <x>"
    rows = [(i, f"http://Host.example/{i}", page.replace("{n}", str(i)), "x") for i in range(5)]
    rows += [(5, None, page, "x"), (6, "http://host.example/", None, "x"), (7, "nowhere", "", "x"), (7, "nowhere", "", "x"), (None, "a://b", "just text", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = html_extract.extract_pages(frame).collect()
    assert len(got) == len(rows)
    assert all(r["text"] == want for r in got if r["page_id"] in range(6))
    assert all(r["text"] == "" for r in got if r["page_id"] in (6, 7)) and [r["text"] for r in got if r["page_id"] is None] == ["just text"]
    assert html_extract.extract_pages(frame.limit(0)).count() == 0


def test_votes_outweigh_an_odd_page(spark):
    usual = "<body><div class=main><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    rows = [(i, "http://h/x", usual.format("long text " * 20, "short")) for i in range(4)] + [(9, "http://h/y", usual.format("brief", "much longer " * 30))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief"


def test_nothing_of_an_article_is_lost(spark):
    """Headlines outside the body's div, parts of different classes, links and boilerplate beside them."""
    long, short = "long text " * 40, "short text " * 8
    menu = "<div class=menu><p>menu</p></div><div class=links><a href=/>elsewhere and elsewhere</a></div>"
    pages = {
        "headline": f"<body>{menu}<article><h1>Title</h1><div class=body><p>{long}</p></div></article></body>",
        "parts": f"<body>{menu}<article><h1>Title</h1><div class=lead><p>{short}</p></div><div class=rest><p>{long}</p></div></article></body>",
        "sections": f"<body>{menu}<main><h1>Title</h1><section class=a><p>{short}</p></section><section class=b><p>{long}</p></section></main></body>",
        "main": f"<body>{menu}<main><h1>Title</h1><article><p>{long}</p></article></main></body>",
        "divs": f"<body>{menu}<div class=post><h1>Title</h1><div class=lead><p>{short}</p></div><div class=rest><p>{long}</p></div></div></body>",
        "linked": f"<body>{menu}<div class=post><h1><a href=/1>Title</a></h1><div class=rest><p>{long}</p></div></div></body>",
        "bare": f"<body><h1>Title</h1><div class=menu><p>menu</p></div><div class=rest><p>{long}</p></div></body>",
        "fragment": f"<h1>Title</h1><div class=menu><p>menu</p></div><div class=rest><p>{long}</p></div>",
    }
    rows = [(f"{kind}{i}", f"http://{kind}/{i}", page) for kind, page in pages.items() for i in range(3)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    for r in got:
        parts = ["Title", short.strip(), long.strip()] if short in pages[r["page_id"][:-1]] else ["Title", long.strip()]
        assert r["text"] == "\n\n".join(parts), r["page_id"]
    assert len(got) == len(rows)


def best_text(source):
    page = html_extract.Page(source)
    return page.text([page.best()])


def test_articles_named_or_wrapped_like_boilerplate():
    body = "<p>" + "long text " * 40 + "</p>"
    want = "Title\n\n" + ("long text " * 40).strip()
    menu = "<header><h1>Site</h1></header><div class=share-box>share</div><div class='post-comments'><p>a comment</p></div>"
    for page in (
        f"<body>{menu}<article><header><h1>Title</h1></header>{body}</article></body>",
        f"<body>{menu}<div class='post share-enabled'><h1>Title</h1>{body}</div></body>",
        f"<body class='has-sidebar'>{menu}<div class=no-sidebar><h1>Title</h1>{body}</div></body>",
        f"<body>{menu}<article class='post social'><h1>Title</h1>{body}</article></body>",
        f"<body><form action=/x>{menu}<div class=main><h1>Title</h1>{body}</div></form></body>",
        f"<body><div class=social>{menu}<main><h1>Title</h1>{body}</main></div></body>",
        f"<body>{menu}<div class=page-content><h1>Title</h1>{body}<form><p>mail address</p></form></div></body>",
    ):
        assert best_text(page) == want, page


def test_values_are_not_names():
    """What stands in an attribute's value hides nothing; hidden and unshown elements go."""
    body = "<p>" + "long text " * 40 + "</p>"
    want = ("long text " * 40).strip()
    shown = (
        "style='overflow:hidden'", 'style="overflow: hidden"', "title='a hidden gem'", 'data-id="nav"', "title='class=sidebar'", 'data-x="id=footer"', "alt = 'role=banner'",
        "data-u=/x/", "data-hidden=1", "data-class=sidebar", "style='background:none'", "onclick=\"this.hidden=true\"", "aria-label='aria-hidden=true'", "aria-hidden=false",
    )
    for attributes in shown:
        for tag in ("body", "main", "article", "div"):
            assert best_text(f"<html><body><{tag} {attributes}>{body}</{tag}>") == want, (tag, attributes)
    for attributes in ("hidden", "hidden=''", "HIDDEN", "style='color:red; display: none'", 'style="display:none"', "aria-hidden=true", "class=a id=x role=search"):
        assert best_text(f"<body><article>{body}<div {attributes}>gone</div></article>") == want, attributes
        assert best_text(f"<body {attributes}><article {attributes}>{body}</article></body>") == want, attributes
    assert best_text(f"<body><article>{body}<div class=share class=text>gone</div></article>") == want  # the first of two counts
    assert best_text(f"<body><article><br/><img src=/a/><hr>{body}<script src=/x/>var a</script></article>") == want


def test_comment_lists_go():
    body = "<p>" + "long text " * 20 + "</p>"
    want = ("long text " * 20).strip()
    lists = ("class=commentlist", "class='comment-list'", "id=replies", "class=reply", "id=discussion", "class='reader-replies'", "id=usercomments", "class='comments-area'", "id=CommentSection")
    for attributes in lists:
        comments = f"<ol {attributes}>" + "<li><p>a reader's own long remark on all of this and more</p></li>" * 30 + "</ol>"
        assert best_text(f"<body><article>{body}{comments}</article></body>") == want, attributes
        assert best_text(f"<body><div class=post>{body}</div>{comments}</body>") == want, attributes


def test_deep_and_long_pages_take_linear_time():
    import time

    for page in ("<b>" * 30_000 + "x", "<div>" * 30_000 + "x", "<p>a<b>" * 30_000, "<table><tr><td>" * 10_000 + "x", "</b>" * 30_000, "<p>" + "word " * 1_000_000):
        began = time.process_time()
        best_text(page)
        assert time.process_time() - began < 3


def test_extraction_equals_the_winning_path_by_hand(spark, sf_dir):
    """The test pages have one article each: its blocks, cut out by patterns."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])[1]
        blocks = re.split(r"</?(?:h1|p)>", inner)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in blocks]
        assert got[r["page_id"]] == "\n\n".join(b for b in plain if b), r["page_id"]


def test_broken_markup():
    for source in ("<", "<a", "<p>a<", "<p class=\"x>y", "<!-- open", "<script>x", "</div></p>", "<div>" * 3000 + "x", "&#xD800;&#0;&bogus;&amp"):
        html_extract.Page(source).text([0])


def brute(rows, k, every, kind=np.float32):
    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    usable = [(i, np.array(v, kind).astype(np.float64)) for i, v in rows if i is not None and sound(v)]
    out = []
    for n, (i, q) in enumerate(usable):
        if i % every == 0:
            found = sorted(((-float(np.cumsum(q * v)[-1]), j) for m, (j, v) in enumerate(usable) if m != n and len(v) == len(q)))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    random_ = np.random.default_rng(7)
    rows = [(i, random_.normal(size=10).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]
    rows += [(2000, None), (2020, [0.0] * 10), (2040, [float("nan")] * 10), (2060, [None] * 10), (2080, [float("inf")] + [1.0] * 9), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as score", "2 as rank")
    got = sorted(map(tuple, ann.neighbours(frame).collect()))
    assert got == brute(rows, 20, 20)
    few = frame.where("vec_id in (0, 1, 2)")
    assert len(ann.neighbours(few).collect()) == 2
    assert ann.neighbours(frame.limit(0)).count() == 0


def test_doubles_and_other_lengths(spark):
    random_ = np.random.default_rng(8)
    rows = [(i, random_.normal(size=(10, 7, 3)[i % 11 % 3]).tolist()) for i in range(200)] + [(400, [1.0]), (420, [2.0]), (440, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ann.neighbours(frame).collect())) == brute(rows, 20, 20, np.float64)
    whole = spark.createDataFrame([(i, [i % 5, 1 + i % 3]) for i in range(60)], "vec_id long, embedding array<int>")
    assert sorted(map(tuple, ann.neighbours(whole).collect())) == brute([(i, [i % 5, 1 + i % 3]) for i in range(60)], 20, 20, np.float64)


def test_recall_on_test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {tuple(r)[:3] for r in ann.neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()}
    want = {r[:3] for r in brute(rows, 20, 20)}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_over_several_chunks(spark):
    """More vectors than one chunk holds, of no structure at all."""
    x = np.random.default_rng(3).normal(size=(3 * ann.CHUNK_ROWS, 32)).astype(np.float32)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").coalesce(3)
    got = {}
    for r in ann.neighbours(frame, every=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.arange(0, len(x), 100)
    products = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    products[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-products, axis=1)[:, :20]
    found = sum(len(got[q] & set(w)) for q, w in zip(asked.tolist(), want.tolist(), strict=True))
    assert found >= 0.9 * want.size


def test_score_aware_codes_keep_products_closer():
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aware = ann.Quantizer.fit(x)
    plain = ann.Quantizer(aware.centroids, 0.0)
    pairs = ann.Quantizer.pairs(x)

    def along(q):
        codes = q.encode_pairs(pairs)
        return np.abs(((pairs - q.centroids[np.arange(codes.shape[1]), codes]) * pairs).sum(axis=(1, 2))).mean()

    assert along(aware) < along(plain)


def test_url_rules(spark):
    urls = [
        "http://example.org/es/1", "http://Sub.Example.org/en/12", "http://example.org/fr/", "http://a.com/fr/1", "https://a.com/de/", "http://acom/de/",
        "http://x.net/login?next=1", "http://x.net/mylogin", "http://x.net/a.exe", "http://x.net/?page=1&ref=b", "nourl", "", None, "a://b?c/d", "http://h#x",
        "http://notexample.org.net/es/",
    ]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(frame).collect()}
    assert got[0] == ("example.org", "/es/1", "example.org/es/", "block") and got[1] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block") and got[5][2] is None
    assert [got[i][3] for i in range(6, 10)] == ["block", "allow", "block", "allow"]
    assert all(got[i][:2] == ("", "") and got[i][3] == "allow" for i in (10, 11, 12)) and got[13][:2] == ("b", "") and got[14][:2] == ("h", "")
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


def test_verdicts_do_not_hang_on_the_literal(spark):
    """What a rule's pattern matches holds each literal as a whole token, whatever stands beside it."""
    urls = [f"http://h/{x}{tail}" for x in (*url_filter.PATH_STEPS, "calendar/2020/01") for tail in ("", "/1", "?a", "#b", "5", "x")]
    urls += [f"http://h/p{sign}{p}=1" for p in url_filter.PARAMETERS for sign in ("?", "?a&", "?a;")]
    urls += [f"http://{host}/" for w in url_filter.HOST_WORDS for host in (w, f"a.{w}.net", f"{w}-x.net", f"x{w}.net", f"a.{w}:80")]
    urls += [f"http://h/a.{e}{tail}" for e in url_filter.FILE_ENDS for tail in ("", "?b", "#c", "x")]
    for rule in url_filter.PATTERN_RULES:
        found = [u for u in urls if re.search(rule.pattern, u)]
        assert found and all(t in url_filter.TOKEN.findall(u) for u in found for t in rule.literals), rule.name
    alone = spark.createDataFrame([(1, "http://h/wp-login.php"), (2, "http://h/wp-login.php5")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.filter_urls(alone).orderBy("page_id").collect()] == ["block", "allow"]


def test_index_gives_what_every_pattern_gives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").limit(200)
    more = [f"http://h{i}.net/{s}" for i, s in enumerate(url_filter.PATH_STEPS)] + ["http://casino.net/a.zip?sid=1", "http://h/wp-json/feed"]
    rows = rows.union(spark.createDataFrame([(-i, u) for i, u in enumerate(more, 1)], "page_id long, url string"))
    for r in url_filter.filter_urls(rows).collect():
        low = r["url"].lower()
        first = next((p.name for p in url_filter.PATTERN_RULES if re.search(p.pattern, low)), None)
        assert r["pattern"] == first, r["url"]


def test_rules_hang_on_their_rarest_literal():
    rule = url_filter.PatternRule("r", "wp-login", ("wp", "login"))
    assert list(url_filter.rule_index((rule,), {"wp": 3, "login": 9})) == ["wp"]
    with pytest.raises(StopIteration):
        next(iter(url_filter.rule_index((), {})))
