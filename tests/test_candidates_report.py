"""Merging, ranking and the report on small investigations."""

import datetime as dt

from pyspark.sql import functions as F

from sightline.operators import candidates as C
from sightline.plans import report as R

AS_OF = F.lit("2026-01-01").cast("timestamp")
ROW = ("inv_id string, pos int, url string, title string, thumb string, image_url string, engine string, copy_id int, match string, "
       "crawl_date string, first_indexed string, engine_date string")


def test_merge_two_engines(spark):
    rows = [
        ("i", 1, "https://site.example/story?utm_source=a", "", "http://t/1", None, "yandex", 1, "similar", None, None, None),
        ("i", 2, "https://site.example/story", "Story", "http://t/2", "http://img/2", "lens", 2, "exact", "2020-01-01", None, None),
        ("i", 3, "https://site.example/tag/x", "L", "ftp://no", None, "lens", None, "exact", None, None, None),
    ]
    df = spark.createDataFrame(rows, ROW)
    m = {r.canonical: r for r in C.merge_candidates(df).collect()}
    a = m["https://site.example/story"]
    assert a.engines == ["yandex", "lens"] and a.match == "exact" and a.copy_ids == [1, 2]
    assert a.title == "Story" and a.crawl_date == "2020-01-01" and a.thumbs == ["http://t/1", "http://img/2", "http://t/2"]
    assert a.url.endswith("utm_source=a") and m["https://site.example/tag/x"].thumbs == []
    ranked = C.rank_candidates(C.merge_candidates(df), AS_OF).orderBy("rank").collect()
    assert [r.is_listing for r in ranked] == [False, True]
    seen = spark.createDataFrame([("i", "https://site.example/story")], "inv_id string, canonical string")
    assert [r.canonical for r in C.merge_candidates(df, seen).collect()] == ["https://site.example/tag/x"]


def test_rank_social_cap_and_thumb_verdicts(spark):
    base = 1700000000000000000
    rows = [("i", n, f"https://x.com/u/status/{base + (14 - n) * 4194304000}", "", None, None, "lens", 1, "exact", None, None, None) for n in range(15)]
    rows += [("i", 20, "https://web.example/a", "", "http://t", None, "lens", 1, "exact", None, None, None),
             ("i", 21, "https://web2.example/a", "", "http://t", None, "lens", 1, "similar", None, None, None)]
    verdict = F.when(F.col("pos") == 20, "differs").when(F.col("pos") == 21, "match")
    m = C.merge_candidates(spark.createDataFrame(rows, ROW)).withColumn("thumb_verdict", verdict)
    got = [r.url for r in C.rank_candidates(m, AS_OF).orderBy("rank").collect()]
    assert len(got) == 14
    ids = [int(u.rsplit("/", 1)[1]) for u in got[:12]]
    assert ids == sorted(ids) and ids[0] == base
    assert got[12:] == ["https://web2.example/a", "https://web.example/a"]


def test_hot_site_and_hot_investigation(spark):
    """Two thirds of all rows on one site of one investigation: caps and merges stay whole."""
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("i"), F.col("id"))).alias("inv_id"), F.col("id").alias("pos"),
        F.concat(F.lit("https://big.example/"), F.col("id") % 500).alias("url"), F.lit("").alias("title"),
        F.concat(F.lit("http://t/"), F.col("id")).alias("thumb"), F.lit(None).cast("string").alias("image_url"), F.lit("lens").alias("engine"),
        F.lit(1).alias("copy_id"), F.lit("exact").alias("match"), *[F.lit(None).cast("string").alias(c) for c in ("crawl_date", "first_indexed", "engine_date")])
    m = C.merge_candidates(df)
    assert m.filter("inv_id = 'hot'").count() == 500
    assert C.candidate_thumbs(C.with_canonical(df)).count() == n
    r = C.rank_candidates(m, AS_OF)
    assert r.filter("inv_id = 'hot'").count() == 3 and r.filter("inv_id <> 'hot'").count() == 1000


def test_prescreen(spark):
    rows = [("i", n, f"https://s{n}.example/a", "", f"http://t/{n}", None, "lens", 1, "similar", None, None, None) for n in range(5)]
    m = C.merge_candidates(spark.createDataFrame(rows, ROW))
    cmp = spark.createDataFrame([
        ("i", "http://t/0", 10, None, 0), ("i", "http://t/1", 30, True, 80), ("i", "http://t/2", 30, False, 4), ("i", "http://t/3", 30, None, 2),
        ("i", "http://t/1", 40, False, 3),
    ], "inv_id string, thumb string, distance int, same_scene boolean, inliers int")
    s = C.prescreen(m, cmp)
    assert {r.pos: r.thumb_verdict for r in s.collect()} == {0: "match", 1: "match", 2: "differs", 3: "unknown", 4: "unknown"}
    (c,) = C.prescreen_counts(s).collect()
    assert (c.match, c.differs, c.unknown) == (2, 1, 2)


def test_prescreen_reads_every_thumbnail(spark):
    rows = [("i", n, "https://s.example/a", "", f"http://t/{n}", None, "lens", 1, "exact", None, None, None) for n in range(7)]
    rows += [("i", 9, "https://z.example/a", "", "http://t/9", None, "lens", 1, "exact", None, None, None)]
    df = spark.createDataFrame(rows, ROW)
    m, thumbs = C.merge_candidates(df), C.candidate_thumbs(C.with_canonical(df))
    cmp = spark.createDataFrame([("i", "http://t/6", 3, None, 0)], "inv_id string, thumb string, distance int, same_scene boolean, inliers int")
    for limit in (None, 1):
        s = C.prescreen(m, cmp, rows=limit, thumbs=thumbs)
        assert {r.pos: (r.thumb_verdict, r.thumb_distance) for r in s.collect()} == {0: ("match", 3), 9: ("unknown", None)}
    assert [r.pos for r in C.rank_candidates(s, AS_OF).orderBy("rank").collect()] == [0, 9]
    assert [len(r.thumbs) for r in C.merge_candidates(df).orderBy("pos").collect()] == [7, 1]


def test_text_queries_and_pools(spark):
    q = C.text_queries(F.array(F.lit("ن١"), F.lit("ن٢")), F.array(F.lit("e1")), F.array(F.lit("A"), F.lit("B")), F.lit("ev"), F.lit("b detail"), limit=3)
    whole = C.text_queries(F.array(F.lit("ن١"), F.lit("ن٢")), F.array().cast("array<string>"), F.array(*map(F.lit, "ABCD")), F.lit("ev"), F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    e = C.text_queries(none, none, none, F.lit("Fire"), F.lit("fire"))
    (r,) = spark.range(1).select(q.alias("q"), e.alias("e"), whole.alias("w"), C.query_locale(F.lit("ن"))["hl"].alias("hl"),
                                 C.frame_urls(F.lit(None).cast("string"), F.array(F.lit("x"), F.lit("http://a"), F.lit("http://b"))).alias("f")).collect()
    assert r.q == ["ن١", "e1", "A B b detail site:x.com"] and r.e == ["Fire site:x.com"] and r.hl == "ar"
    assert r.w == ["ن١", "A B C D site:x.com", "ن٢"]
    assert r.f.primary == "http://a" and r.f.extra == ["http://b"]
    cands = spark.createDataFrame([("i", n, f"https://s.example/{n}", t) for n, t in enumerate(["One", "one ", "", "Two"])], "inv_id string, pos int, url string, title string")
    titles = C.title_pool(cands)
    assert [r.title for r in titles.orderBy("pos").collect()] == ["One", "Two"]
    assert [(r.title, r.rank) for r in C.title_pool(cands, limit=1).collect()] == [("One", 1)]
    s = spark.createDataFrame([("i", n, f"cap {n}", "TWO" if n == 0 else f"t{n}", ("page",)) for n in range(20)], "inv_id string, pos int, caption string, title string, image struct<level:string>")
    caps = [r.caption for r in C.caption_pool(s, titles, 12).orderBy("rank").collect()]
    assert caps[:3] == ["cap 0", "cap 1", "t1"] and len(caps) == 13 and caps[-1] == "t6"
    assert C.caption_pool(s, titles).count() == 39


SIGHT = ("inv_id string, pos int, url string, canonical string, title string, caption string, image struct<level:string,kind:string,matched_url:string,phash:int,note:string,frame:int>, "
         "date struct<level:string,when:timestamp,upper_bound:timestamp,sources:array<string>>, match string, thumbs array<string>, round int")


def sight(pos, url, level, kind, date_level, when, bound=None, frame=None):
    at = lambda x: dt.datetime.fromisoformat(x) if x else None
    return ("i", pos, url, url, f"T{pos}", None, (level, kind, None, None, None, frame), (date_level, at(when), at(bound), []), "exact", [], 1)


def five(spark):
    return spark.createDataFrame([
        sight(1, "https://x.com/i/status/1", "platform", "variant", "platform_id", "2024-07-19T16:31:42", frame=0),
        sight(2, "https://b.example/claim", "engine_claim", "exact", "structured", "2021-05-28"),
        sight(3, "https://c.example/weak", "page", "exact", "weak", "2019-01-01"),
        sight(4, "https://d.example/tag/x", "page", "exact", "structured", "2020-01-01"),
        sight(5, "https://e.example/later", "page", "exact", "structured", "2024-07-19T16:43:55", frame=1),
        sight(6, "https://f.example/none", "none", None, "none", None),
        sight(7, "https://g.example/undated", "page", "exact", "none", None, bound="2018-01-01"),
    ], SIGHT)


def test_origin_timeline_leads(spark):
    s = five(spark)
    (o,) = R.origins(s).collect()
    assert o.first_seen.pos == 1 and o.first_exact.pos == 5
    assert [r.pos for r in R.timeline(s, ordered=True).collect()] == [3, 4, 2, 1, 5, 7]
    assert [r.pos for r in R.leads(s).orderBy("lead_rank").collect()] == [3, 4, 2, 7]
    assert {r.frame: r.first_seen.pos for r in R.scenes(s).collect()} == {1: 1, 2: 5}
    items = {r.link: r for r in R.public_item(s).collect()}
    assert items["https://g.example/undated"].date_text == R.AT_LEAST_SINCE + "2018-01-01" and items["https://g.example/undated"].is_upper_bound
    assert items["https://b.example/claim"].visual.verdict == "ambiguous" and items["https://f.example/none"].date_text == R.NO_DATE


def test_day_only_does_not_beat_exact_time(spark):
    s = spark.createDataFrame([
        sight(1, "https://a.example/1", "page", "exact", "structured", "2024-07-19T00:00:00"),
        sight(2, "https://x.com/i/status/2", "page", "exact", "platform_id", "2024-07-19T16:00:00"),
    ], SIGHT)
    assert R.origins(s).collect()[0].first_seen.pos == 2


def test_facets_and_bench(spark):
    t = spark.createDataFrame([("i", n, u) for n, u in enumerate(["https://x.com/a", "https://old.reddit.com/x", "https://a.example/", "https://vk.com/x"])], "inv_id string, pos int, link string")
    assert {r.facet: r.n for r in R.facet_counts(t).collect()} == {"X": 1, "Reddit": 1, "ويب": 2}
    old = spark.createDataFrame([("a", "pass"), ("b", "fail"), ("c", "acceptable")], "id string, verdict string")
    new = spark.createDataFrame([("a", "fail"), ("b", "pass"), ("c", "acceptable"), ("d", "fail")], "id string, verdict string")
    assert [r.id for r in R.bench_regressions(new, old).collect()] == ["a"]
