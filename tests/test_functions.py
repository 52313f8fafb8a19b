"""Links, dates and documents: fixed cases on tiny tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.functions import dates, html, urls
from sightline.operators import evidence as E

AS_OF = F.lit("2026-01-01").cast("timestamp")


def values(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


URLS = [
    ("https://twitter.com/svs9111/status/570514380095299584?lang=cs&s=20", "https://x.com/i/status/570514380095299584", False, False, "x"),
    ("https://x.com/IndiaCoastGuard/status/1814337329387175999/photo/1", "https://x.com/i/status/1814337329387175999", False, False, "x"),
    ("https://youtu.be/EA6bWERKe3w", "https://www.youtube.com/watch?v=EA6bWERKe3w", False, False, "youtube"),
    ("https://m.youtube.com/watch?v=EA6bWERKe3w&feature=share&t=10", "https://www.youtube.com/watch?v=EA6bWERKe3w", False, False, "youtube"),
    ("not a url", None, False, True, "web"),
    ("", None, False, True, "web"),
    ("https://site.example/tag/ships", "https://site.example/tag/ships", True, False, "web"),
    ("https://x.com/svs9111", "https://x.com/svs9111", True, False, "x"),
    ("https://lens.google.com/x", "https://lens.google.com/x", False, True, "web"),
    ("https://it.pinterest.com/pin/1/", "https://it.pinterest.com/pin/1", False, False, "pinterest"),
    ("HTTP://User:pw@Site.Example:8080/A b/?b=2&a=1%20x&sort=9&c=&k=~*#f", "https://site.example/A b?a=1+x&b=2&k=~%2A", False, False, "web"),
    ("https://site.example", "https://site.example/", True, False, "web"),
    ("https://site.example/list?page=2", "https://site.example/list?page=2", True, False, "web"),
    ("https://www.linkedin.com/in/someone/", "https://www.linkedin.com/in/someone", True, False, "web"),
    ("https://t.me/channel/123", "https://t.me/channel/123", False, False, "telegram"),
    ("https://t.me/channel", "https://t.me/channel", True, False, "telegram"),
]


def test_url_cases(spark):
    u = F.col("url")
    got = values(spark, [(r[0],) for r in URLS], "url string", "url", urls.canonical(u), urls.is_listing(u), urls.is_junk(u), urls.platform_of(u))
    assert [tuple(r) for r in got] == URLS
    staged = urls.with_url_identity(spark.createDataFrame([(r[0],) for r in URLS], "url string"))
    assert [tuple(r) for r in staged.select("url", "canonical", "is_listing", "is_junk", "platform").collect()] == URLS


def test_url_edges(spark):
    rows = [("https://ex.com/a.JPG?x=1", "https://m.facebook.com/p"), ("https://[::1]:80/x", "https://www.x.com/a/"), (None, None)]
    a, b = F.col("a"), F.col("b")
    got = values(spark, rows, "a string, b string", urls.is_image_url(a), urls.host_of(a), urls.canonical(b), urls.is_social(b), urls.platform_facet(b))
    assert tuple(got[0]) == (True, "ex.com", "https://www.facebook.com/p", True, "Facebook")
    assert tuple(got[1]) == (False, "::1", "https://x.com/a", True, "X")
    assert got[2][0] is False and got[2][2] is None


@pytest.mark.parametrize("url,want,conf,source", [
    ("https://x.com/user/status/1700000000000000000", "2023-09-08T04:15:59Z", 0.98, "platform:twitter_snowflake"),
    ("https://www.instagram.com/p/C9fXkFqNn6Q/", "2024-07-16T16:22:52Z", 0.95, "platform:instagram_shortcode"),
    ("https://www.tiktok.com/@user/video/7393000000000000000", "2024-07-18T15:35:48Z", 0.95, "platform:tiktok_id"),
    ("https://x.com/user/status/99999999999999999999", None, None, None),
    ("https://other.example/status/1700000000000000000", None, None, None),
])
def test_platform_dates(spark, url, want, conf, source):
    e = dates.platform_date(F.col("u"), AS_OF)
    (row,) = values(spark, [(url,)], "u string", dates.to_iso(e["date"]), e["confidence"], e["source"])
    assert tuple(row) == (want, conf, source)


def test_shortcode_of_every_length(spark):
    alphabet = dates.SHORTCODE_ALPHABET
    codes = ["C9fXkFqNn6Q"[:n] for n in (9, 10, 11)] + ["_" * 11, "A" * 9, "C9fXkFqNn6Qz"]

    def by_hand(code):
        n = 0
        for ch in code[:11]:
            n = n * 64 + alphabet.index(ch)
        return (n >> 23) + dates.INSTAGRAM_EPOCH_MS

    got = values(spark, [(c,) for c in codes], "c string", dates.shortcode_millis(F.col("c")))
    assert [r[0] for r in got] == [by_hand(c) for c in codes]


DATES = {
    "2021-03-04T12:00:00+02:00": "2021-03-04T10:00:00Z", "1614852000": "2021-03-04T10:00:00Z",
    "1614852000000": "2021-03-04T10:00:00Z", "2999-01-01": None, "not a date": None, "4 March 2021": "2021-03-04T00:00:00Z",
    "mar 4, 2021": "2021-03-04T00:00:00Z", "4/3/2021": "2021-03-04T00:00:00Z", "20210304": "2021-03-04T00:00:00Z",
    "Wed, 21 Oct 2015 07:28:00 GMT": "2015-10-21T07:28:00Z", "Wed Oct 10 20:19:24 +0000 2018": "2018-10-10T20:19:24Z",
    "2021-13-01": None, "1994-01-01": None, "  2021-03-04 ": "2021-03-04T00:00:00Z", "2021-03-04 garbage": None,
}


def test_parse_date(spark):
    got = values(spark, [(k,) for k in DATES], "v string", "v", dates.to_iso(dates.parse_date(F.col("v"), AS_OF)))
    assert {r[0]: r[1] for r in got} == DATES


def test_date_shapes(spark):
    (r,) = values(spark, [("2020:05:06 07:08:09",)], "raw string", dates.to_iso(dates.capture_date(F.lit(None).cast("string"), F.col("raw"), F.lit("x"), AS_OF)))
    assert r[0] == "2020-05-06T07:08:09Z"
    rows = [("2024-07-19", "2024-07-19T00:00:00Z"), ("2024-07-19T01:02:03Z", "2024-07-19T01:02:03Z"),
            ("2024-07-19T01:02:03+03:00", "2024-07-19T01:02:03+03:00"), ("2024-07-19T01:02:03", "2024-07-19T01:02:03Z")]
    got = values(spark, rows, "v string, want string", dates.rfc3339(F.col("v")), "want")
    assert all(r[0] == r[1] for r in got)
    (r,) = values(spark, [("2024-07-19T01:02:03+03:00",)], "v string", dates.stored_timestamp(F.col("v")))
    assert r[0] == dt.datetime(2024, 7, 19, 1, 2, 3)
    paths = {"https://n.example/2021/3/4/x": ("2021-03-04", .65), "https://n.example/2021-03-04/x": ("2021-03-04", .65),
             "https://n.example/2021/03/": ("2021-03-01", .4), "https://n.example/2021/13/40/": None, "https://n.example/x": None}
    e = dates.url_path_date(F.col("u"), AS_OF)
    for r in values(spark, [(p,) for p in paths], "u string", "u", F.date_format(e["date"], "yyyy-MM-dd"), e["confidence"]):
        assert (paths[r[0]] or (None, None)) == (r[1], r[2])


def test_header_and_platform_pages(spark):
    (r,) = values(spark, [("https://t.me/ch/5", '<time class="t" datetime="2022-02-03T04:05:06+00:00">', "Thu, 01 Jan 2026 10:00:00 GMT")],
                  "u string, h string, m string", dates.platform_page_date(F.col("u"), F.col("h"), AS_OF)["source"], dates.header_date(F.col("m"), AS_OF))
    assert r[0] == "platform:telegram_time" and r[1] is None
    (r,) = values(spark, [("https://www.facebook.com/p/1", '{"creation_time":1614852000}')], "u string, h string",
                  dates.to_iso(dates.platform_page_date(F.col("u"), F.col("h"), AS_OF)["date"]))
    assert r[0] == "2021-03-04T10:00:00Z"


DOC = """<html><head><meta content="2020-05-01T10:00:00Z" property="article:published_time"><meta name="date" content="2020-05-02">
<meta property=og:title content="A &amp; B"><title>zz</title><meta name="description" content=" d "></head><body>
<time datetime="2019-01-01" pubdate>y</time><span itemprop="datePublished">3 May 2018</span>
<img src="b.png" width="50"><img src='c.png' width="500px"><img data-src="//cdn.example/x.svg"><img src="data:xx"></body>"""
GRAPH = """<script type="application/ld+json">{"@graph":[{"datePublished":"2021-01-01","image":"/own.png"},{"@graph":[{"dateCreated":"2022-02-02"}]}]}</script>
<script type="application/ld+json">[{"image":["u.jpg",{"url":"http://z.example/q.jpg"}]}]</script><p>t</p>"""


def test_html_evidence(spark):
    h = F.col("h")
    rows = values(spark, [(DOC,), (GRAPH,), ("<p>Hello 12 may 2019 <!-- 2011-01-01 --> <script>2012-01-01</script></p>",), ("",)],
                  "h string", F.transform(html.html_date_evidence(h, AS_OF), lambda e: F.concat_ws("|", e["source"], e["confidence"].cast("string"), F.date_format(e["date"], "yyyy-MM-dd"))),
                  html.title(h, F.lit("fb")), html.caption(h), html.candidate_images(h, F.lit("https://s.example/d/p.html")))
    assert rows[0][0] == ["meta:article:published_time|0.95|2020-05-01", "meta:date|0.7|2020-05-02", "time:pubdate|0.8|2019-01-01",
                          "time:datetime|0.65|2019-01-01", "itemprop:datePublished|0.65|2018-05-03"]
    assert rows[0][1] == "A & B" and rows[0][2] == " d " and rows[0][3] == ["https://s.example/d/c.png"]
    assert rows[1][0] == ["jsonld:datePublished|0.9|2021-01-01", "jsonld:dateCreated|0.85|2022-02-02"]
    assert rows[1][3] == ["https://s.example/d/u.jpg", "http://z.example/q.jpg"]
    assert rows[2][0] == ["text:pattern_match|0.45|2019-05-12"]
    assert rows[3][0] == [] and rows[3][1] == "fb"


def test_structured_dates_are_found_at_any_depth(spark):
    deep = lambda inner, n: inner if n == 0 else '{"@graph":[[%s]]}' % deep(inner, n - 1)
    page = '<script type="application/ld+json">%s</script>'
    docs = [(page % deep('{"datePublished":"2020-01-%02d"}' % (n + 1), n),) for n in (0, 5, 10, 25)]
    got = values(spark, docs, "h string", F.transform(html.jsonld_date_evidence(F.col("h"), AS_OF), lambda e: F.date_format(e["date"], "yyyy-MM-dd")))
    assert [r[0] for r in got] == [["2020-01-01"], ["2020-01-06"], ["2020-01-11"], ["2020-01-26"]]


def test_first_hit_dates_are_read_from_whole_values(spark):
    said = "Posted by the newsroom of the Example Daily on the day of 2021-03-04"
    docs = [("time", f"<time datetime='{said}'>x</time><span itemprop=datePublished>2011-01-01</span>"), ("text", f"<time datetime>{said}</time>"),
            ("item", f"<span itemprop='datePublished'>{said}</span>"), ("json", '<script type="application/ld+json">{"datePublished":"%s"}</script>' % said)]
    hit = E.first_hit_date(F.lit("https://n.example/x"), F.col("h"))
    got = values(spark, docs, "k string, h string", "k", F.date_format(hit["published_at"], "yyyy-MM-dd"), hit["evidence"])
    assert {tuple(r) for r in got} == {("time", "2021-03-04", "time:datetime"), ("text", "2021-03-04", "time:datetime"),
                                       ("item", "2021-03-04", "itemprop:datePublished"), ("json", "2021-03-04", "jsonld:datePublished")}


def test_fresh_dates_are_capped(spark):
    doc = '<meta property="article:published_time" content="2025-12-31T20:00:00Z">'
    (r,) = values(spark, [(doc,)], "h string", html.html_date_evidence(F.col("h"), AS_OF))
    assert r[0][0].confidence == 0.3 and r[0][0].source.endswith("?fresh")


def ev(kind, date, conf, source):
    return ("p", kind, dt.datetime.fromisoformat(date), conf, source)


@pytest.mark.parametrize("rows,want", [
    ([ev("evidence", "2020-06-01T08:30:00", .95, "meta:a"), ev("evidence", "2020-06-01", .65, "url:p"), ev("evidence", "2021-01-01", .45, "text:x")], ("2020-06-01T08:30:00Z", .99, False)),
    ([ev("evidence", "2022-03-01", .8, "htmldate:o"), ev("bound", "2019-05-05", .6, "w:c")], ("2019-05-05T00:00:00Z", .6, True)),
    ([ev("evidence", "2022-03-01", .95, "meta:a"), ev("bound", "2019-05-05", .6, "w:c")], ("2022-03-01T00:00:00Z", .95, False)),
    ([ev("bound", "2019-05-05", .75, "w:c")], ("2019-05-05T00:00:00Z", .75, True)),
    ([ev("evidence", "2022-03-01", .87, "time:d"), ev("evidence", "2022-03-01T05:00:00", .4, "url:m"), ev("bound", "2019-05-05", .6, "w:c")], ("2022-03-01T00:00:00Z", .91, False)),
    ([ev("evidence", "2022-03-01", .85, "time:d"), ev("evidence", "2022-03-01T05:00:00", .4, "url:m"), ev("bound", "2019-05-05", .6, "w:c")], ("2019-05-05T00:00:00Z", .6, True)),
])
def test_resolve_both_ways(spark, rows, want):
    df = spark.createDataFrame(rows, "page string, kind string, date timestamp, confidence double, source string")
    (r,) = E.resolve_rows(df, ["page"]).select(dates.to_iso(F.col("published_at")), F.round("confidence", 4), "is_upper_bound").collect()
    assert tuple(r) == want
    packed = df.groupBy("page").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("date", "confidence", "source"))).alias(k) for k in ("evidence", "bound")])
    x = E.resolve(F.col("evidence"), F.col("bound"))
    (r,) = packed.select(dates.to_iso(x["published_at"]), F.round(x["confidence"], 4), x["is_upper_bound"]).collect()
    assert tuple(r) == want


def test_nothing_to_resolve(spark):
    none = F.array().cast(f"array<{dates.EVIDENCE}>")
    (r,) = spark.range(1).select(E.resolve(none, none).alias("r")).select("r.*").collect()
    assert r.published_at is None and r.confidence == 0.0 and r.is_upper_bound is False


def test_page_levels(spark):
    pages = [
        ("https://x.com/u/status/1814337329387175999", "", None, None, None),
        ("https://n.example/a", '<meta property="article:published_time" content="2020-05-01">', None, None, "2019-01-01"),
        ("https://n.example/tag/x", '<meta property="article:published_time" content="2020-05-01">', None, None, None),
        ("https://n.example/b", '<meta name="date" content="2020-05-01">', None, None, "2019-01-01"),
        ("https://n.example/c", "<p>x</p>", "Wed, 21 Oct 2015 07:28:00 GMT", None, None),
    ]
    df = spark.createDataFrame(pages, "url string, html string, last_modified string, tweet_created_at string, crawl_date string")
    got = {r.url: (r.date.level, str(r.date.when or "")[:10], str(r.date.upper_bound or "")[:10]) for r in E.date_pages(df, AS_OF).collect()}
    assert got == {
        pages[0][0]: ("platform_id", "2024-07-19", ""), pages[1][0]: ("structured", "2020-05-01", "2019-01-01"),
        pages[2][0]: ("weak", "2020-05-01", ""), pages[3][0]: ("none", "", "2019-01-01"), pages[4][0]: ("weak", "2015-10-21", ""),
    }


def test_captures_and_archive(spark):
    c = spark.createDataFrame([("u", "20150321104455", "200"), ("u", "20140101000000", "404"), ("u", "20160101000000", "301")], "url string, timestamp string, statuscode string")
    (r,) = E.earliest_capture(c).collect()
    assert r.captured_at == dt.datetime(2015, 3, 21, 10, 44, 55)
    o = spark.createDataFrame([("u",), ("v",)], "url string")
    got = {r.url: r.archived for r in E.archive_links(o, c).collect()}
    assert got["u"].status == "existing" and got["u"].url.endswith("/20150321104455/u")
    assert got["v"].status == "failed" and "/*/v" in got["v"].url
