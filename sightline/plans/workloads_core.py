"""Queries over links, dates, candidates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import dates, html, urls
from sightline.operators import candidates as C
from sightline.operators import evidence as E
from sightline.operators.skew import widen
from sightline.plans import report as R
from sightline.plans.readings import (
    AS_OF, HOST_SQL, MERGED_SQL, ORDER_SQL, PAGE_ROWS_SQL, SCORED_SQL, SIGHTINGS_SQL, as_of, canonical_sql,
    listing_sql, page_rows, sightings,
)
from sightline.plans.registry import query, table

TS = "yyyy-MM-dd HH:mm:ss"


def iso(c):
    return F.date_format(c, TS)


# --------------------------------------------------------------------------------------------- links

@query(f"SELECT page_id, {canonical_sql('url')} AS canonical FROM pages")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


# A third of the pages share one identity, whatever their own links are.
SHARED_URL_SQL = "CASE WHEN page_id % 3 = 0 THEN 'https://shared.example/story?utm_source=' || page_id ELSE url END"


@query(f"""
WITH c AS (SELECT page_id, {canonical_sql(SHARED_URL_SQL)} AS canonical FROM pages)
SELECT page_id, min(page_id) OVER w AS same_id, count(*) OVER w AS members FROM c WINDOW w AS (PARTITION BY canonical)""")
def url_same(spark, sf):
    """Links that are the same post, as classes: a row per link with the class's first and its size, no pairs."""
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://shared.example/story?utm_source="), "page_id")).otherwise(F.col("url"))
    p = table(spark, sf, "pages").select("page_id", u.alias("url"))
    return C.same_links(p, "page_id").select("page_id", F.col("same_id"), "members")


@query(f"""
SELECT page_id, {HOST_SQL} AS host, regexp_replace({HOST_SQL}, '^www[.]', '') AS domain,
       regexp_matches({HOST_SQL}, 'google[.]|bing[.]com|yandex[.]|tineye[.]com|archive[.]org') AS is_junk,
       regexp_matches({HOST_SQL}, '(^|[.])(x[.]com|twitter[.]com|facebook[.]com|instagram[.]com|t[.]me|youtube[.]com)$') AS is_social,
       regexp_matches(url, '^[^?#]*[.](jpg|jpeg|png|webp|gif|avif|bmp)([?#]|$)') AS is_image,
       {listing_sql(canonical_sql('url'))} AS is_listing
FROM pages""")
def url_flags(spark, sf):
    p = urls.with_url_identity(table(spark, sf, "pages").select("page_id", "url"))
    return p.select("page_id", "host", "domain", "is_junk", "is_social",
                    urls.is_image_url(F.col("url")).alias("is_image"), "is_listing")


SOCIAL_URL_SQL = """
CASE page_id % 6 WHEN 0 THEN 'https://twitter.com/u' || page_id || '/status/' || (1500000000000000000 + page_id)
  WHEN 1 THEN 'https://www.instagram.com/p/C9fXkFqNn' || (page_id % 10) || 'Q/'
  WHEN 2 THEN 'https://youtu.be/EA6bWERKe3' || (page_id % 10)
  WHEN 3 THEN 'https://it.pinterest.com/pin/' || page_id || '/'
  WHEN 4 THEN 'https://t.me/ch/' || page_id ELSE url END"""


def _social(spark, sf):
    pid = F.col("page_id")
    link = (
        F.when(pid % 6 == 0, F.concat(F.lit("https://twitter.com/u"), pid, F.lit("/status/"), F.lit(1500000000000000000) + pid))
        .when(pid % 6 == 1, F.concat(F.lit("https://www.instagram.com/p/C9fXkFqNn"), pid % 10, F.lit("Q/")))
        .when(pid % 6 == 2, F.concat(F.lit("https://youtu.be/EA6bWERKe3"), pid % 10))
        .when(pid % 6 == 3, F.concat(F.lit("https://it.pinterest.com/pin/"), pid, F.lit("/")))
        .when(pid % 6 == 4, F.concat(F.lit("https://t.me/ch/"), pid)).otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", link.alias("url"))


@query(f"""
WITH s AS (SELECT page_id, {SOCIAL_URL_SQL} AS url FROM pages)
SELECT page_id,
  CASE page_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'instagram' WHEN 2 THEN 'youtube' WHEN 3 THEN 'pinterest'
    WHEN 4 THEN 'telegram' ELSE 'web' END AS platform,
  CASE page_id % 6 WHEN 0 THEN 'X' WHEN 1 THEN 'Instagram' WHEN 2 THEN 'YouTube' WHEN 4 THEN 'Telegram' ELSE 'ويب' END AS facet
FROM s""")
def url_platform(spark, sf):
    return _social(spark, sf).select(
        "page_id", urls.platform_of(F.col("url")).alias("platform"), urls.platform_facet(F.col("url")).alias("facet")
    )


@query(f"""
WITH s AS (SELECT page_id, {SOCIAL_URL_SQL} AS url FROM pages)
SELECT page_id,
  CASE WHEN page_id % 6 = 0 THEN 'u' || page_id || '/' || (1500000000000000000 + page_id) END AS x_post,
  CASE WHEN page_id % 6 = 1 THEN 'https://www.instagram.com/p/C9fXkFqNn' || (page_id % 10) || 'Q/media/?size=l' END AS instagram_media,
  CASE WHEN page_id % 6 = 2 THEN 'https://i.ytimg.com/vi/EA6bWERKe3' || (page_id % 10) || '/hq2.jpg' END AS youtube_frame,
  url || '?name=orig' AS original,
  'https://tineye.com/search?url=' || replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '#', '%23') AS manual_link
FROM (SELECT page_id, replace(replace(url, '&', ''), '?', '') AS url FROM s)""")
def url_derived(spark, sf):
    s = _social(spark, sf).withColumn("url", F.translate("url", "&?", ""))
    u = F.col("url")
    post = urls.x_post(u)
    return s.select(
        "page_id", F.concat(post["user"], F.lit("/"), post["id"]).alias("x_post"),
        urls.instagram_media_url(u).alias("instagram_media"),
        F.get(urls.youtube_frame_urls(u), F.lit(2)).alias("youtube_frame"),
        urls.original_size_url(u).alias("original"), urls.manual_engine_links(u)["tineye"].alias("manual_link"),
    )


@query("""
SELECT o_orderkey, 'uploads/' || o_custkey || '/' || o_orderkey || '.jpg' AS storage_key FROM orders
WHERE o_orderkey % 2 = 0""")
def storage_keys(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    host = F.when(F.col("o_orderkey") % 2 == 0, "acct.r2.cloudflarestorage.com").otherwise("cdn.example")
    link = F.concat(F.lit("https://"), host, F.lit("/bucket/uploads/"), F.col("o_custkey"), F.lit("/"),
                    F.col("o_orderkey"), F.lit(".jpg?X-Sig=a%2Fb"))
    return o.select("o_orderkey", urls.storage_key(link).alias("storage_key")).filter(F.col("storage_key").isNotNull())


# --------------------------------------------------------------------------------------------- dates

WHEN_SQL = "(o_orderdate + INTERVAL 18 YEARS + to_seconds(o_orderkey % 86400))"


def _orders_when(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return o.withColumn("at", F.col("o_orderdate") + F.expr("INTERVAL 18 YEARS") + F.make_interval(
        secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)")))


@query(f"""
SELECT o_orderkey, strftime({WHEN_SQL}, '%Y-%m-%d %H:%M:%S') AS date, 0.98 AS confidence,
       'platform:twitter_snowflake' AS source FROM orders""")
def snowflake_date(spark, sf):
    o = _orders_when(spark, sf)
    post = F.shiftleft(F.unix_millis("at") - F.lit(dates.X_EPOCH_MS), 22) + F.col("o_orderkey") % 4194304
    # Ids have 15 digits at least; earlier ones are left-padded so that every row carries a valid id.
    e = dates.platform_date(F.concat(F.lit("https://x.com/u/status/"), F.lpad(post.cast("string"), 19, "0")), as_of())
    return o.select("o_orderkey", e.alias("e")).select(
        "o_orderkey", iso(F.col("e.date")).alias("date"), F.col("e.confidence"), F.col("e.source"))


@query(f"""
SELECT o_orderkey, strftime({WHEN_SQL}, '%Y-%m-%d %H:%M:%S') AS date, 0.95 AS confidence,
       'platform:tiktok_id' AS source FROM orders""")
def tiktok_date(spark, sf):
    o = _orders_when(spark, sf)
    post = F.shiftleft(F.unix_seconds("at"), 32) + F.col("o_orderkey")
    e = dates.platform_date(F.concat(F.lit("https://www.tiktok.com/@u/video/"), post), as_of())
    return o.select("o_orderkey", e.alias("e")).select(
        "o_orderkey", iso(F.col("e.date")).alias("date"), F.col("e.confidence"), F.col("e.source"))


@query(f"""
WITH d AS (SELECT o_orderkey, o_orderdate + INTERVAL 18 YEARS AS d FROM orders)
SELECT o_orderkey,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL
       WHEN o_orderkey % 4 = 2 THEN strftime(date_trunc('month', d), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS date,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN 0.4 ELSE 0.65 END AS confidence,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN 'url:path_month' ELSE 'url:path_date' END AS source
FROM d""")
def date_path(spark, sf):
    at = F.col("o_orderdate") + F.expr("INTERVAL 18 YEARS")
    k = F.col("o_orderkey") % 4
    part = (
        F.when(k == 0, F.date_format(at, "/yyyy/M/d/")).when(k == 1, F.date_format(at, "/yyyy-MM-dd-"))
        .when(k == 2, F.date_format(at, "/yyyy/MM/")).otherwise("/2031/13/45/")
    )
    part = F.when(k == 1, F.regexp_replace(part, "-$", "/")).otherwise(part)
    link = F.concat(F.lit("https://news.example"), part, F.lit("p"), F.col("o_orderkey"))
    e = dates.url_path_date(link, as_of())
    return table(spark, sf, "orders").select("o_orderkey", e.alias("e")).select(
        "o_orderkey", F.date_format("e.date", "yyyy-MM-dd").alias("date"), F.col("e.confidence"), F.col("e.source"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
       strftime(o_orderdate + INTERVAL 11 HOURS, '%Y-%m-%d %H:%M:%S') AS offset_applied,
       strftime(o_orderdate + INTERVAL 13 HOURS, '%Y-%m-%d %H:%M:%S') AS offset_dropped,
       strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS rfc3339
FROM orders""")
def date_parse(spark, sf):
    """Seven spellings of one day, an offset applied on reading and dropped on storing."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    spelled = None
    for i, f in enumerate(("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd", "dd/MM/yyyy")):
        spelled = F.when(k == i, F.date_format(d, f)) if spelled is None else spelled.when(k == i, F.date_format(d, f))
    spelled = spelled.otherwise(F.unix_seconds(d).cast("string"))
    # Epoch seconds have ten digits only from 2001 on; earlier days use the compact form.
    spelled = F.when((k == 6) & (F.length(spelled) < 10), F.date_format(d, "yyyyMMdd")).otherwise(spelled)
    zoned = F.date_format(d, "yyyy-MM-dd'T13:00:00+02:00'")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(dates.parse_date(spelled, as_of()), "yyyy-MM-dd").alias("day"),
        iso(dates.parse_date(zoned, as_of())).alias("offset_applied"),
        F.date_format(dates.stored_timestamp(zoned), TS).alias("offset_dropped"),
        dates.rfc3339(F.date_format(d, "yyyy-MM-dd")).alias("rfc3339"),
    )


EVIDENCE_SQL = """
ev AS (
  SELECT 'pg' || l_orderkey AS page_id,
    CASE WHEN l_linenumber = 7 THEN 'bound' ELSE 'evidence' END AS kind,
    l_shipdate + to_hours(CAST(l_suppkey % 24 AS INTEGER)) AS date,
    CASE l_linenumber WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.65 WHEN 4 THEN 0.45 WHEN 5 THEN 0.8 WHEN 6 THEN 0.87 ELSE 0.75 END AS confidence,
    CASE l_linenumber WHEN 1 THEN 'meta:article:published_time' WHEN 2 THEN 'jsonld:datePublished' WHEN 3 THEN 'url:path_date'
      WHEN 4 THEN 'text:pattern_match' WHEN 5 THEN 'meta:pubdate' WHEN 6 THEN 'time:datetime' ELSE 'tineye:crawl_date' END AS source
  FROM (SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN TIMESTAMP '1998-06-01' ELSE l_shipdate END AS l_shipdate) FROM lineitem)
  WHERE NOT (l_linenumber = 1 AND l_suppkey % 3 > 0) AND NOT (l_linenumber = 2 AND l_suppkey % 3 = 0)),
best AS (
  SELECT page_id, arg_min(date, (-confidence, date)) AS d, max(confidence) AS c FROM ev WHERE kind = 'evidence' GROUP BY 1),
agree AS (
  SELECT b.page_id, b.d, b.c, count(DISTINCT split_part(e.source, ':', 1)) AS kinds,
    max(CASE WHEN split_part(e.source, ':', 1) IN ('meta', 'jsonld', 'time') THEN 2 ELSE 1 END) AS lvl
  FROM best b JOIN ev e ON e.page_id = b.page_id AND e.kind = 'evidence' AND CAST(e.date AS DATE) = CAST(b.d AS DATE)
  GROUP BY ALL),
bound AS (SELECT page_id, min(date) AS bd FROM ev WHERE kind = 'bound' GROUP BY 1),
joined AS (
  SELECT page_id, d, bd, lvl, CASE WHEN kinds >= 2 THEN least(0.99, c + 0.04) ELSE c END AS trust
  FROM (SELECT DISTINCT page_id FROM ev) LEFT JOIN agree USING (page_id) LEFT JOIN bound USING (page_id)),
resolved AS (
  SELECT page_id, bd, lvl, d, trust, bd IS NOT NULL AND (d IS NULL OR (d > bd AND trust < 0.9)) AS by_bound FROM joined)"""


def _evidence_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    n = F.col("l_linenumber")
    kinds = (
        (1, "meta:article:published_time", 0.95), (2, "jsonld:datePublished", 0.9), (3, "url:path_date", 0.65),
        (4, "text:pattern_match", 0.45), (5, "meta:pubdate", 0.8), (6, "time:datetime", 0.87), (7, "tineye:crawl_date", 0.75),
    )
    source = conf = None
    for i, s, c in kinds:
        source = F.when(n == i, s) if source is None else source.when(n == i, s)
        conf = F.when(n == i, c) if conf is None else conf.when(n == i, c)
    day = F.when(F.col("l_partkey") % 3 == 0, F.lit("1998-06-01").cast("timestamp")).otherwise(F.col("l_shipdate"))
    return li.filter(~((n == 1) & (F.col("l_suppkey") % 3 > 0)) & ~((n == 2) & (F.col("l_suppkey") % 3 == 0))).select(
        F.concat(F.lit("pg"), F.col("l_orderkey")).alias("page_id"),
        F.when(n == 7, "bound").otherwise("evidence").alias("kind"),
        (day + F.make_interval(hours=(F.col("l_suppkey") % 24).cast("int"))).alias("date"),
        conf.alias("confidence"), source.alias("source"),
    )


_RESOLVED_SQL = f"""
WITH {EVIDENCE_SQL}
SELECT page_id, strftime(CASE WHEN by_bound THEN bd ELSE d END, '%Y-%m-%d %H:%M:%S') AS published_at,
  round(CASE WHEN by_bound AND d IS NULL THEN 0.75 WHEN by_bound THEN 0.75 ELSE trust END, 4) AS confidence, by_bound AS is_upper_bound
FROM resolved"""


@query(_RESOLVED_SQL)
def date_resolve(spark, sf):
    r = E.resolve_rows(_evidence_rows(spark, sf), ["page_id"])
    return r.select("page_id", iso(F.col("published_at")).alias("published_at"),
                    F.round("confidence", 4).alias("confidence"), "is_upper_bound")


@query(f"""
WITH {EVIDENCE_SQL}
SELECT page_id, CASE WHEN by_bound OR d IS NULL THEN 'none' WHEN lvl = 2 THEN 'structured' ELSE 'weak' END AS level,
  CASE WHEN NOT by_bound THEN strftime(d, '%Y-%m-%d %H:%M:%S') END AS date, strftime(bd, '%Y-%m-%d %H:%M:%S') AS upper_bound
FROM resolved""")
def date_level(spark, sf):
    r = E.resolve_rows(_evidence_rows(spark, sf), ["page_id"])
    g = E.grade(F.struct("is_upper_bound", "published_at", "level_rank", "bound_at"), F.lit(False))
    return r.select("page_id", g.alias("g")).select(
        "page_id", F.col("g.level"), iso(F.col("g.when")).alias("date"), iso(F.col("g.upper_bound")).alias("upper_bound"))


PAGE_HTML_SQL = """
hp AS (
  SELECT o_orderkey, o_orderdate + INTERVAL 18 YEARS AS d, o_orderkey % 6 AS k FROM orders)"""


def _html_pages(spark, sf):
    """Small documents that state the order date in six different places."""
    d, k = F.col("o_orderdate") + F.expr("INTERVAL 18 YEARS"), F.col("o_orderkey") % 6
    day = F.date_format(d, "yyyy-MM-dd")
    cat = F.concat
    doc = (
        F.when(k == 0, cat(F.lit('<head><meta content="'), day, F.lit('T08:30:00Z" property="article:published_time"/></head>')))
        .when(k == 1, cat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"A","datePublished":"'), day, F.lit('"}]}</script>')))
        .when(k == 2, cat(F.lit("<body><time class='x' datetime='"), day, F.lit("'>then</time></body>")))
        .when(k == 3, cat(F.lit("<body><!-- 2001-01-01 --><p>Posted "), F.date_format(d, "d MMMM yyyy"), F.lit("</p></body>")))
        .when(k == 4, cat(F.lit('<span itemprop="datePublished">'), day, F.lit('</span><meta name="date" content="'), day, F.lit('">')))
        .otherwise("<body><p>no date</p></body>")
    )
    return widen(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select(
        "o_orderkey", F.concat(F.lit("https://news.example/a/"), F.col("o_orderkey")).alias("url"), doc.alias("html"),
        F.when(k == 5, F.concat(F.date_format(d, "EEE"), F.lit(", "), F.date_format(d, "dd MMM yyyy"), F.lit(" 10:00:00 GMT"))).alias("last_modified"),
        F.lit(None).cast("string").alias("tweet_created_at"),
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(F.date_sub(d, 10), "yyyy-MM-dd")).alias("crawl_date"),
    )


@query(f"""
WITH {PAGE_HTML_SQL}
SELECT o_orderkey, unnest(CASE k WHEN 0 THEN ['meta:article:published_time|0.95|' || strftime(d, '%Y-%m-%d 08:30:00')]
  WHEN 1 THEN ['jsonld:datePublished|0.9|' || strftime(d, '%Y-%m-%d 00:00:00')]
  WHEN 2 THEN ['time:datetime|0.65|' || strftime(d, '%Y-%m-%d 00:00:00')]
  WHEN 3 THEN ['text:pattern_match|0.45|' || strftime(d, '%Y-%m-%d 00:00:00')]
  WHEN 4 THEN ['itemprop:datePublished|0.65|' || strftime(d, '%Y-%m-%d 00:00:00'), 'meta:date|0.7|' || strftime(d, '%Y-%m-%d 00:00:00')]
  ELSE [] END) AS evidence FROM hp""")
def html_dates(spark, sf):
    p = _html_pages(spark, sf)
    e = p.select("o_orderkey", F.explode(html.html_date_evidence(F.col("html"), as_of())).alias("e"))
    return e.select("o_orderkey", F.concat_ws("|", "e.source", F.col("e.confidence").cast("string"), iso(F.col("e.date"))).alias("evidence"))


LANDED_SQL = """lp AS (SELECT page_id, page_id % 4 AS k, DATE '2015-01-01' + CAST(page_id % 3000 AS INTEGER) AS d FROM pages)"""


@query(f"""
WITH {LANDED_SQL}
SELECT page_id, unnest(CASE k WHEN 0 THEN ['meta:article:published_time|0.95|' || strftime(d, '%Y-%m-%d 08:30:00')]
  WHEN 1 THEN ['jsonld:datePublished|0.9|' || strftime(d, '%Y-%m-%d 00:00:00'), 'jsonld:uploadDate|0.9|' || strftime(d + 1, '%Y-%m-%d 00:00:00')]
  WHEN 2 THEN ['time:datetime|0.65|' || strftime(d, '%Y-%m-%d 00:00:00'), 'itemprop:datePublished|0.65|' || strftime(d, '%Y-%m-%d 00:00:00'),
    'time:datePublished|0.8|' || strftime(d, '%Y-%m-%d 00:00:00')] ELSE [] END) AS evidence FROM lp""")
def html_dates_landed(spark, sf):
    """Whole landed pages into whose heads and articles a dated tag is set; those without one state no date."""
    k, d = F.col("page_id") % 4, F.date_add(F.lit("2015-01-01").cast("date"), (F.col("page_id") % 3000).cast("int"))
    day, cat = F.date_format(d, "yyyy-MM-dd"), F.concat
    graph = cat(F.lit('<head><script type="application/ld+json">{"@graph":[{"@type":"A [b"},[[{"datePublished":"'), day,
                F.lit('"}]],{"@graph":[{"uploadDate":"'), F.date_format(F.date_add(d, 1), "yyyy-MM-dd"), F.lit('"}]}]}</script>'))
    head = F.when(k == 0, cat(F.lit("<head><meta content='"), day, F.lit("T08:30:00Z' property='article:published_time'>"))).when(k == 1, graph).otherwise("<head>")
    body = F.when(k == 2, cat(F.lit('<article><time itemprop="datePublished" datetime="'), day, F.lit('">then</time>'))).otherwise("<article>")
    p = table(spark, sf, "pages").select("page_id", F.replace(F.replace("html", F.lit("<head>"), head), F.lit("<article>"), body).alias("html"))
    stated = F.concat(html.jsonld_date_evidence(F.col("html"), as_of()), html.tag_date_evidence(F.col("html"), as_of()))
    return p.select("page_id", F.explode(stated).alias("e")).select(
        "page_id", F.concat_ws("|", "e.source", F.col("e.confidence").cast("string"), iso(F.col("e.date"))).alias("evidence"))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
  [s FOR s IN string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/')] AS parts FROM pages),
f AS (SELECT *, list_slice(parts, 1, -2) AS folder, list_slice(parts, 1, -3) AS above FROM u)
SELECT page_id, unnest([
  origin || '/' || array_to_string(list_concat(above, ['img', page_id || '.jpg?a=../b']), '/'), origin || '/top/' || page_id || '.png',
  origin || '/' || array_to_string(list_concat(folder, ['pics', 'a' || page_id || '.png']), '/'), 'https://cdn.example/x/../' || page_id]) AS image FROM f""")
def candidate_images(spark, sf):
    """Pictures set into whole landed pages: relative links with dot segments, ones too small or drawn, and repeats."""
    cat, n = F.concat, F.col("page_id")
    head = cat(F.lit('<head><meta property="og:image" content="../img/'), n, F.lit('.jpg?a=../b"><meta content="/a/.././top/'), n, F.lit('.png" name="twitter:image">'))
    body = cat(F.lit('<article><img src="./pics/b/../a'), n, F.lit('.png" width="300px"><img src="/i.svg"><img src="/s.png" height=20><img data-src="https://cdn.example/x/../'), n,
               F.lit('"><img src="data:image/png;base64,AA"><img src="/top/'), n, F.lit('.png">'))
    p = table(spark, sf, "pages").select("page_id", "url", F.replace(F.replace("html", F.lit("<head>"), head), F.lit("<article>"), body).alias("html"))
    return p.select("page_id", F.explode(html.candidate_images(F.col("html"), F.col("url"))).alias("image"))


@query("SELECT page_id, 0 AS n_stated FROM pages")
def html_date_none(spark, sf):
    """Whole landed pages that state no date anywhere."""
    p = table(spark, sf, "pages").select("page_id", "html")
    found = F.concat(html.jsonld_date_evidence(F.col("html"), as_of()), html.tag_date_evidence(F.col("html"), as_of()))
    return p.select("page_id", F.size(found).alias("n_stated"))


@query(f"""
WITH {PAGE_HTML_SQL},
e AS (SELECT o_orderkey, k, o_orderkey % 5 = 0 AS bounded, d - INTERVAL 10 DAYS AS b,
  CASE k WHEN 0 THEN d + INTERVAL 510 MINUTES WHEN 5 THEN d + INTERVAL 10 HOURS ELSE d END AS seen,
  CASE k WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.65 WHEN 3 THEN 0.45 WHEN 4 THEN 0.74 ELSE 0.35 END AS c,
  CASE k WHEN 0 THEN 'structured' WHEN 1 THEN 'structured' WHEN 2 THEN 'structured' WHEN 4 THEN 'structured' ELSE 'weak' END AS lvl FROM hp)
SELECT o_orderkey, CASE WHEN bounded AND c < 0.9 THEN 'none' ELSE lvl END AS level,
  CASE WHEN NOT (bounded AND c < 0.9) THEN strftime(seen, '%Y-%m-%d %H:%M:%S') END AS date,
  CASE WHEN bounded THEN strftime(b, '%Y-%m-%d %H:%M:%S') END AS upper_bound FROM e""")
def page_dates(spark, sf):
    """Evidence, resolve and level of every landed page in one row-local pass."""
    d = E.date_pages(_html_pages(spark, sf), as_of())
    return d.select("o_orderkey", F.col("date.level").alias("level"), iso(F.col("date.when")).alias("date"),
                    iso(F.col("date.upper_bound")).alias("upper_bound"))


@query(f"""
WITH {PAGE_HTML_SQL}
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS day,
  CASE k WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 WHEN 4 THEN 0.75 END AS confidence,
  CASE k WHEN 0 THEN 'meta:article:published_time' WHEN 1 THEN 'jsonld:datePublished' WHEN 2 THEN 'time:datetime'
    WHEN 4 THEN 'meta:date' END AS evidence
FROM (SELECT * REPLACE (CASE WHEN k IN (3, 5) THEN NULL ELSE d END AS d) FROM hp)""")
def date_waterfall_v1(spark, sf):
    """The earlier first-hit order; JSON-LD inside ``@graph`` was not opened there, so the list form is given."""
    p = _html_pages(spark, sf).withColumn(
        "html", F.replace(F.replace("html", F.lit('{"@graph":['), F.lit("[")), F.lit("]}"), F.lit("]")))
    hit = E.first_hit_date(F.col("url"), F.col("html"))
    return p.select("o_orderkey", hit.alias("h")).select(
        "o_orderkey", F.date_format("h.published_at", "yyyy-MM-dd").alias("day"), F.col("h.confidence"), F.col("h.evidence"))


@query("""
WITH c AS (SELECT 'https://s' || l_suppkey || '.example/' AS url,
  strftime(l_shipdate + to_seconds(l_partkey % 3600), '%Y%m%d%H%M%S') AS ts, l_linenumber FROM lineitem),
f AS (SELECT url, min(ts) AS ts FROM c WHERE l_linenumber NOT IN (4, 5) AND ts >= '1996' GROUP BY 1),
o AS (SELECT 'https://s' || s_suppkey || '.example/' AS url FROM supplier)
SELECT o.url, 'https://web.archive.org/web/' || coalesce(f.ts, '*') || '/' || o.url AS archived,
  CASE WHEN f.ts IS NULL THEN 'failed' ELSE 'existing' END AS status
FROM o LEFT JOIN f USING (url)""")
def archive_links(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_shipdate")
    captures = li.select(
        F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example/")).alias("url"),
        F.date_format(F.col("l_shipdate") + F.make_interval(secs=(F.col("l_partkey") % 3600).cast("decimal(18,6)")), "yyyyMMddHHmmss").alias("timestamp"),
        F.when(F.col("l_linenumber") == 4, "404").when(F.col("l_linenumber") == 5, "503").when(F.col("l_linenumber") == 6, "301").otherwise("200").alias("statuscode"),
    )
    sites = table(spark, sf, "supplier").select(F.concat(F.lit("https://s"), F.col("s_suppkey"), F.lit(".example/")).alias("url"))
    return E.archive_links(sites, captures).select("url", F.col("archived.url").alias("archived"), F.col("archived.status").alias("status"))


@query("""
SELECT o_orderkey, strftime(o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 5 HOURS WHEN o_orderkey % 3 = 1 THEN INTERVAL 6 HOURS ELSE INTERVAL 7 HOURS END,
  '%Y-%m-%d %H:%M:%S') AS captured_at FROM orders""")
def capture_dates(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    at = lambda h: F.date_format(d + F.expr(f"INTERVAL {h} HOURS"), "yyyy:MM:dd HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", iso(dates.capture_date(
        F.when(k == 0, at(5)), F.when(k <= 1, at(6)), at(7), as_of())).alias("captured_at"))


@query("""
SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS title FROM pages""")
def page_title_caption(spark, sf):
    """Title of every landed page; captions are read whole in :func:`page_captions`."""
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html"), urls.domain_of(F.col("url"))).alias("title"))


def _text_sql(cut: str) -> str:
    """Visible text of a page: code and ``cut`` elements out, pieces stripped and joined, entities read."""
    body = "regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'gis')"
    for tag in cut.split():
        body = f"regexp_replace({body}, '<{tag}\\b.*?</{tag}>', ' ', 'gis')"
    ws = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
    pieces = f"list_transform(string_split_regex({body}, '<[^>]*>'), lambda p: trim(p, {ws}))"
    text = f"array_to_string(list_filter({pieces}, lambda p: p <> ''), ' ')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"),
                       ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


@query(f"SELECT page_id, regexp_replace({_text_sql('nav footer header')}, '\\s+', ' ', 'g') AS caption FROM pages")
def page_captions(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.caption(F.col("html")).alias("caption"))


# ---------------------------------------------------------------------------------------- candidates

@query(f"""
WITH {MERGED_SQL}
SELECT inv_id, canonical, pos, url, match, engines, copy_ids, title, crawl_date, engine_date, thumbs FROM merged""")
def candidates_merge(spark, sf):
    m = C.merge_candidates(page_rows(spark, sf))
    return m.select("inv_id", "canonical", "pos", "url", "match", F.array_join("engines", ",").alias("engines"),
                    F.array_join("copy_ids", ",").alias("copy_ids"), F.coalesce("title", F.lit("")).alias("title"),
                    "crawl_date", "engine_date", F.array_join("thumbs", ",").alias("thumbs"))


@query(f"WITH {MERGED_SQL} SELECT inv_id, canonical, thumb, slot FROM thumb_firsts")
def candidate_thumbs(spark, sf):
    return C.candidate_thumbs(C.with_canonical(page_rows(spark, sf)))


@query(f"""
WITH {PAGE_ROWS_SQL}
SELECT inv_id, canonical, count(*) AS n FROM page_rows r
WHERE NOT EXISTS (SELECT 1 FROM page_rows s WHERE s.inv_id = r.inv_id AND s.canonical = r.canonical AND (s.pos // 2) % 2 = 0)
GROUP BY ALL""")
def candidates_seen_anti(spark, sf):
    rows = C.with_canonical(page_rows(spark, sf))
    seen = rows.filter(F.floor(F.col("pos") / 2) % 2 == 0)
    return C.drop_seen(rows, seen).groupBy("inv_id", "canonical").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {SCORED_SQL},
site AS (SELECT *, row_number() OVER (PARTITION BY inv_id, domain ORDER BY score,
  CASE WHEN date_hint = '' THEN '9999' ELSE date_hint END, pos) AS domain_rank FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY score,
  CASE WHEN date_hint = '' THEN '9999' ELSE date_hint END, pos) AS rank FROM site WHERE domain_rank <= 3)
SELECT inv_id, canonical, domain, CAST(score AS INTEGER) AS score, date_hint, domain_rank, rank FROM ranked WHERE rank <= 40""")
def candidates_rank_cap(spark, sf):
    merged = C.merge_candidates(page_rows(spark, sf))
    return C.rank_candidates(merged, as_of(), 3, 40).select(
        "inv_id", "canonical", "domain", "score", "date_hint", "domain_rank", "rank")


@query(f"""
WITH {PAGE_ROWS_SQL},
norm AS (SELECT inv_id, pos, url, match, title FROM page_rows WHERE (pos // 2) % 11 <> 0)
SELECT * FROM norm""")
def candidates_normalise(spark, sf):
    """Raw engine rows to candidates; every eleventh page is given an engine's own address and drops out."""
    r = page_rows(spark, sf)
    junk = F.floor(F.col("pos") / 2) % 11 == 0
    raw = r.select(
        "inv_id", "pos", "engine", "copy_id", F.col("match").alias("default_match"),
        F.when(junk, F.lit("https://www.google.com/search")).otherwise(F.col("url")).alias("link"), "title",
        F.col("thumb").alias("thumbnail"), "image_url", F.lit(None).cast("string").alias("match_type"),
        "crawl_date", "first_indexed", F.col("engine_date").alias("date"))
    return C.normalise_rows(raw).select("inv_id", "pos", "url", "match", "title")


V1_SQL = f"""WITH {PAGE_ROWS_SQL},
v1 AS (SELECT inv_id, pos, canonical AS link, thumb AS thumbnail, title,
  CASE match WHEN 'exact' THEN 'exact' WHEN 'similar' THEN 'similar' ELSE 'page_match' END AS match_type FROM page_rows),
r1 AS (SELECT *, CASE match_type WHEN 'exact' THEN 0 WHEN 'similar' THEN 1 ELSE 2 END AS rk FROM v1)"""


def _v1_rows(spark, sf):
    r = C.with_canonical(page_rows(spark, sf))
    return r.select("inv_id", "pos", F.col("canonical").alias("link"), F.col("thumb").alias("thumbnail"), "title",
                    F.when(F.col("match").isin("exact", "similar"), F.col("match")).otherwise("page_match").alias("match_type"))


@query(V1_SQL + """
SELECT inv_id, link, arg_min(match_type, (rk, pos)) AS match_type, arg_min(coalesce(title, ''), (rk, pos)) AS title, min(pos) AS pos
FROM r1 GROUP BY ALL""")
def reverse_merge_v1(spark, sf):
    return C.merge_links_v1(_v1_rows(spark, sf)).select("inv_id", "link", "match_type", "title", "pos")


@query(V1_SQL + """,
f AS (SELECT inv_id, link, arg_min(match_type, pos) AS match_type, min(pos) AS pos FROM r1 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY CASE match_type WHEN 'exact' THEN 0 WHEN 'similar' THEN 1 ELSE 2 END, pos) AS rank FROM f)
SELECT inv_id, link, match_type, rank FROM n""")
def candidate_cap_v1(spark, sf):
    return C.cap_links_v1(_v1_rows(spark, sf)).select("inv_id", "link", "match_type", "rank")


@query(V1_SQL + """,
f AS (SELECT inv_id, thumbnail, arg_min(link, pos) AS link, min(pos) AS pos FROM r1 WHERE thumbnail IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY pos) AS rank FROM f)
SELECT inv_id, thumbnail, link, regexp_extract(link, '^https://([^/]+)', 1) AS source, rank FROM n""")
def gallery_v1(spark, sf):
    return C.gallery_v1(_v1_rows(spark, sf)).select("inv_id", "thumbnail", "link", "source", "rank")


@query(f"""
WITH {SCORED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY pos) AS n FROM merged),
t AS (SELECT inv_id, canonical, string_split(thumbs, ',') AS two FROM r WHERE thumbs <> ''),
u AS (SELECT inv_id, canonical, generate_subscripts(two, 1) AS slot, unnest(two) AS thumb FROM t),
j AS (SELECT *, length(thumb) + CAST(regexp_extract(thumb, '/([0-9]+)', 1) AS BIGINT) % 37 AS h FROM u
      WHERE CAST(regexp_extract(thumb, '/([0-9]+)', 1) AS BIGINT) % 5 <> 0),
v AS (SELECT inv_id, canonical, arg_min(CASE WHEN h % 30 <= 12 THEN 'match' WHEN h % 3 = 0 THEN 'match' WHEN h % 3 = 1 THEN 'differs' ELSE 'unknown' END, slot) AS verdict
      FROM j GROUP BY ALL)
SELECT m.inv_id, count(*) FILTER (coalesce(verdict, 'unknown') = 'match') AS match,
  count(*) FILTER (coalesce(verdict, 'unknown') = 'differs') AS differs, count(*) FILTER (coalesce(verdict, 'unknown') = 'unknown') AS unknown
FROM merged m LEFT JOIN v USING (inv_id, canonical) GROUP BY ALL""")
def prescreen_verdicts(spark, sf):
    """Thumbnail comparisons derived from the thumbnail links; every fifth page's thumbnail is unreadable."""
    merged = C.merge_candidates(page_rows(spark, sf))
    thumbs = C.candidate_thumbs(C.with_canonical(page_rows(spark, sf)))
    t = thumbs.select("inv_id", "thumb").distinct()
    no = F.regexp_extract("thumb", "/([0-9]+)", 1).cast("bigint")
    h = F.length("thumb") + no % 37
    comparisons = t.filter(no % 5 != 0).select(
        "inv_id", "thumb", (h % 30).cast("int").alias("distance"),
        F.when(h % 3 == 0, True).when(h % 3 == 1, False).alias("same_scene"), F.lit(40).alias("inliers"))
    return C.prescreen_counts(C.prescreen(merged, comparisons, thumbs=thumbs))


@query("""
WITH a AS (SELECT 'c' || o_custkey AS inv_id, o_orderkey, o_orderkey % 4 AS l, o_orderkey % 5 AS s FROM orders),
b AS (SELECT inv_id, o_orderkey,
  CASE l WHEN 0 THEN 'lens_exact_en' WHEN 1 THEN 'lens_visual' WHEN 2 THEN 'lens_exact_en@small' ELSE 'lens_visual@small' END AS label,
  CASE s WHEN 0 THEN 'refused' WHEN 1 THEN 'results' WHEN 2 THEN 'empty' WHEN 3 THEN 'refused' ELSE 'error' END AS status FROM a),
x AS (SELECT b.*, CASE WHEN starts_with(label, 'lens_exact') AND status = 'refused' AND EXISTS (
    SELECT 1 FROM b t WHERE t.inv_id = b.inv_id AND t.label = replace(b.label, 'exact_en', 'visual') AND t.status IN ('results', 'empty'))
  THEN 'empty' ELSE status END AS fixed FROM b)
SELECT inv_id, label, arg_max(fixed, o_orderkey) AS status, arg_max(o_orderkey % 6, o_orderkey) AS count FROM x GROUP BY ALL""")
def engine_briefs(spark, sf):
    """Answers with the refused-to-empty relabel, then one brief per label."""
    return C.engine_brief(C.relabel_refused(_answers(spark, sf))).select("inv_id", "label", "status", "count")


def _answers(spark, sf):
    l, s = F.col("o_orderkey") % 4, F.col("o_orderkey") % 5
    return table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("inv_id"), F.col("o_orderkey").alias("pos"),
        F.when(l == 0, "lens_exact_en").when(l == 1, "lens_visual").when(l == 2, "lens_exact_en@small").otherwise("lens_visual@small").alias("label"),
        F.when(s.isin(0, 3), "refused").when(s == 1, "results").when(s == 2, "empty").otherwise("error").alias("status"),
        (F.col("o_orderkey") % 6).alias("n_candidates"), F.lit(1).alias("credits"),
        F.when(F.col("o_orderkey") % 7 == 0, "fetch_failed").alias("note"), F.lit(1).alias("copy_id"))


@query("""
WITH b AS (SELECT 'c' || o_custkey AS inv_id, o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN 'lens_exact_en' WHEN 1 THEN 'lens_visual' WHEN 2 THEN 'lens_exact_en@small' ELSE 'lens_visual@small' END AS label,
  o_orderkey % 5 IN (0, 3) AS refused, o_orderkey % 7 = 0 AS failed FROM orders),
l AS (SELECT inv_id, label, arg_max(refused OR failed, o_orderkey) AS bad FROM b GROUP BY ALL)
SELECT inv_id, string_agg(label, ',' ORDER BY label) AS failed FROM l WHERE bad GROUP BY 1""")
def failed_engines(spark, sf):
    f = C.failed_engines(C.engine_brief(_answers(spark, sf)))
    return f.select("inv_id", F.array_join("failed", ",").alias("failed"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 5 IN (1, 2) AND o_orderkey % 6 < 3""")
def thin_answers(spark, sf):
    return C.thin_answers(_answers(spark, sf)).select(F.col("pos").alias("o_orderkey"))


@query("""
WITH s AS (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT source, doc_id * 1000000 + generate_subscripts(lines, 1) - 1 AS pos, trim(unnest(lines), chr(32) || chr(9) || chr(13) || chr(12) || chr(11) || chr(160)) AS line FROM s)
SELECT source, arg_min(line, pos) AS title, min(pos) AS pos FROM t WHERE line <> '' GROUP BY source, lower(line)""")
def title_pool(spark, sf):
    """Every line of every document is a title of its source."""
    lines = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "title"))
    d = lines.select("source", (F.col("doc_id") * 1000000 + F.col("n")).alias("pos"), "title",
                     F.concat(F.lit("https://site.example/"), F.col("doc_id")).alias("url"))
    return C.title_pool(d, "source").select("source", "title", "pos")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE 'clerk ' || o_orderkey % 50 || ' at ' || o_orderstatus END AS caption,
  CASE WHEN o_orderkey % 3 = 0 THEN 'CLERK ' || o_orderkey % 50 ELSE o_orderpriority || ' ' || o_orderkey % 4 END AS title,
  CASE o_orderkey % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'platform' WHEN 2 THEN 'thumb' ELSE 'none' END AS level FROM orders),
p AS (SELECT DISTINCT o_custkey, lower(title) AS key FROM s WHERE o_orderkey % 2 = 1),
t AS (SELECT o_custkey, o_orderkey * 2 AS place, caption AS words FROM s WHERE level IN ('page', 'platform')
  UNION ALL SELECT o_custkey, o_orderkey * 2 + 1, title FROM s WHERE level IN ('page', 'platform'))
SELECT 'c' || o_custkey AS inv_id, arg_min(words, place) AS caption, min(place) AS place FROM t
WHERE (o_custkey, lower(words)) NOT IN (SELECT o_custkey, key FROM p) GROUP BY o_custkey, lower(words)""")
def caption_pool(spark, sf):
    """Captions and titles of confirmed pages; every second page's title is in the title pool already."""
    k = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("inv_id"), k.alias("pos"), F.concat(F.lit("https://site.example/"), k).alias("url"),
        F.when(k % 5 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("clerk "), k % 50, F.lit(" at "), "o_orderstatus")).alias("caption"),
        F.when(k % 3 == 0, F.concat(F.lit("CLERK "), k % 50)).otherwise(F.concat("o_orderpriority", F.lit(" "), k % 4)).alias("title"),
        F.struct(F.when(k % 4 == 0, "page").when(k % 4 == 1, "platform").when(k % 4 == 2, "thumb").otherwise("none").alias("level")).alias("image"))
    found = C.caption_pool(s, C.title_pool(s.filter(k % 2 == 1).drop("image")))
    return found.select("inv_id", "caption", (F.col("at.pos") * 2 + F.col("at.slot")).alias("place"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'بحث ' || c_custkey ELSE 'find ' || c_custkey END AS query,
  CASE WHEN c_custkey % 3 = 0 THEN 'ar-sa' ELSE 'en-us' END AS locale, 0 AS slot FROM customer
UNION ALL SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment ELSE '' END || ' site:x.com', 'en-us', 1 FROM customer""")
def text_queries(spark, sf):
    c = table(spark, sf, "customer")
    arabic = F.col("c_custkey") % 3 == 0
    none = F.array().cast("array<string>")
    qs = C.text_queries(
        F.when(arabic, F.array(F.concat(F.lit("بحث "), F.col("c_custkey")))).otherwise(none),
        F.when(~arabic, F.array(F.concat(F.lit("find "), F.col("c_custkey")))).otherwise(none),
        F.array("c_name"), F.lit("event"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return c.select("c_custkey", F.posexplode(qs).alias("slot", "query")).select(
        "c_custkey", "query", F.concat_ws("-", C.query_locale(F.col("query"))["hl"], C.query_locale(F.col("query"))["gl"]).alias("locale"), "slot")


@query("""
WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'http://a.example/' || o_orderkey END AS own,
  'http://b.example/' || o_orderkey % 7 AS first, 'https://c.example/' || o_orderkey AS second FROM orders)
SELECT o_orderkey, coalesce(own, first) AS main, CASE WHEN own IS NULL THEN second ELSE first || ' ' || second END AS extra FROM u""")
def frame_links(spark, sf):
    """Frame lists with strings that are no links and repeats of the main one."""
    k = F.col("o_orderkey")
    listed = F.array(F.lit("frame"), F.concat(F.lit("http://b.example/"), k % 7), F.lit(None).cast("string"), F.concat(F.lit("https://c.example/"), k))
    f = C.frame_urls(F.when(k % 3 == 0, F.concat(F.lit("http://a.example/"), k)), listed)
    return table(spark, sf, "orders").select("o_orderkey", f.alias("f")).select(
        "o_orderkey", F.col("f.primary").alias("main"), F.array_join("f.extra", " ").alias("extra"))


# ------------------------------------------------------------------------- dates in codes and fresh dates

@query(f"""
WITH c AS (SELECT o_orderkey, 'C' || substr(md5(o_orderkey::VARCHAR), 1, 10) AS code FROM orders),
n AS (SELECT o_orderkey, list_sum(list_transform(range(1, 9), lambda i:
  (strpos('{dates.SHORTCODE_ALPHABET}', code[i]) - 1)::BIGINT * (1::BIGINT << CAST(6 * (8 - i) AS INTEGER))))::BIGINT AS top FROM c),
d AS (SELECT o_orderkey, date_trunc('second', make_timestamp(((top >> 5) + {dates.INSTAGRAM_EPOCH_MS}) * 1000)) AS moment,
  make_timestamp(((top >> 5) + {dates.INSTAGRAM_EPOCH_MS}) * 1000) <= TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY AS ok FROM n)
SELECT o_orderkey, CASE WHEN ok THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END AS date, CASE WHEN ok THEN 0.95 END AS confidence FROM d""")
def shortcode_date(spark, sf):
    """Codes made from order keys; some of them lie after the day of reading and have no date."""
    code = F.concat(F.lit("C"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 10))
    e = dates.platform_date(F.concat(F.lit("https://www.instagram.com/p/"), code, F.lit("/")), as_of())
    return table(spark, sf, "orders").select("o_orderkey", e.alias("e")).select("o_orderkey", iso(F.col("e.date")).alias("date"), "e.confidence")


@query(f"""
WITH d AS (SELECT o_orderkey, TIMESTAMP '{AS_OF}' - to_seconds((o_orderkey % 72) * 3600) AS moment, o_orderkey % 72 <= 36 AS fresh,
  CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.2 END AS conf FROM orders)
SELECT o_orderkey, strftime(moment, '%Y-%m-%d %H:%M:%S') AS date, CASE WHEN fresh THEN least(conf, 0.3) ELSE conf END AS confidence,
  CASE WHEN fresh THEN 'meta:date?fresh' ELSE 'meta:date' END AS source FROM d""")
def fresh_date(spark, sf):
    k = F.col("o_orderkey")
    at = as_of() - F.make_interval(hours=k.cast("int") % 72)
    e = dates.cap_fresh(dates.evidence(at, F.when(k % 2 == 0, 0.9).otherwise(0.2), "meta:date"), as_of())
    return table(spark, sf, "orders").select("o_orderkey", e.alias("e")).select(
        "o_orderkey", iso(F.col("e.date")).alias("date"), "e.confidence", "e.source")


@query(f"""
WITH d AS (SELECT o_orderkey, o_orderkey % 3 AS k, {WHEN_SQL} AS moment FROM orders)
SELECT o_orderkey, CASE WHEN k < 2 THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END AS date, CASE k WHEN 0 THEN 0.95 WHEN 1 THEN 0.92 END AS confidence,
  CASE k WHEN 0 THEN 'platform:telegram_time' WHEN 1 THEN 'platform:facebook_creation_time' END AS source FROM d""")
def platform_page_date(spark, sf):
    """A message's time tag, a post's creation second, and a site that is neither."""
    o = _orders_when(spark, sf)
    k, sec = F.col("o_orderkey") % 3, F.unix_seconds("at").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://t.me/channel/"), "o_orderkey")).when(k == 1, F.lit("https://www.facebook.com/x")).otherwise(F.lit("https://s.example/a"))
    body = F.concat(F.lit('<html><time class="t" datetime="'), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+00:00">x</time><script>{"creation_time":'), sec, F.lit("}</script></html>"))
    e = dates.platform_page_date(url, body, as_of())
    return o.select("o_orderkey", e.alias("e")).select("o_orderkey", iso(F.col("e.date")).alias("date"), "e.confidence", "e.source")


# -------------------------------------------------------------------------------------------- report

@query(f"""
WITH {SIGHTINGS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY {ORDER_SQL}) AS r FROM flagged WHERE ok)
SELECT inv_id, pos, url, strftime(when_at, '%Y-%m-%d %H:%M:%S') AS published_at, date_level FROM n WHERE r = 1""")
def first_seen(spark, sf):
    o = R.origins(sightings(spark, sf))
    return o.select("inv_id", "first_seen.pos", "first_seen.url", iso(F.col("first_seen.date.when")).alias("published_at"),
                    F.col("first_seen.date.level").alias("date_level"))


@query(f"""
WITH {SIGHTINGS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY {ORDER_SQL}) AS r FROM flagged WHERE ok),
e AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY {ORDER_SQL}) AS r2 FROM n WHERE kind = 'exact')
SELECT e.inv_id, e.pos, e.url FROM e JOIN n ON n.inv_id = e.inv_id AND n.r = 1 AND n.kind = 'variant' WHERE e.r2 = 1""")
def first_exact(spark, sf):
    o = R.origins(sightings(spark, sf)).filter(F.col("first_exact").isNotNull())
    return o.select("inv_id", "first_exact.pos", "first_exact.url")


@query(f"""
WITH {SIGHTINGS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY inv_id, frame ORDER BY {ORDER_SQL}) AS r FROM flagged WHERE ok)
SELECT inv_id, frame + 1 AS frame, pos FROM n WHERE r = 1""")
def frame_scenes(spark, sf):
    return R.scenes(sightings(spark, sf)).select("inv_id", "frame", "first_seen.pos")


@query(f"""
WITH {SIGHTINGS_SQL}
SELECT inv_id, pos, strftime(when_at, '%Y-%m-%d') AS day, -lvl AS neg_level, ok AS is_eligible FROM flagged WHERE image_level <> 'none'""")
def timeline(spark, sf):
    t = R.timeline(sightings(spark, sf))
    return t.select("inv_id", "pos", F.date_format("order_key.day", "yyyy-MM-dd").alias("day"), "order_key.neg_level", "is_eligible")


@query(f"""
WITH {SIGHTINGS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY {ORDER_SQL}) AS lead_rank FROM flagged WHERE image_level <> 'none' AND NOT ok)
SELECT inv_id, pos, lead_rank FROM n""")
def leads(spark, sf):
    return R.leads(sightings(spark, sf)).select("inv_id", "pos", "lead_rank")


@query(f"""
WITH {SIGHTINGS_SQL}
SELECT inv_id, pos, coalesce(strftime(when_at, '%Y-%m-%d'), 'على الأقل منذ ' || strftime(upper_bound, '%Y-%m-%d'), 'بدون تاريخ') AS date_text,
  CASE image_level WHEN 'engine_claim' THEN 'ambiguous' WHEN 'none' THEN 'unverified' ELSE 'confirmed' END AS verdict,
  CASE date_level WHEN 'platform_id' THEN 0.98 WHEN 'structured' THEN 0.9 WHEN 'weak' THEN 0.4 END AS confidence,
  upper_bound IS NOT NULL AND when_at IS NULL AS is_upper_bound, regexp_extract(url, '^https://([^/]+)', 1) AS domain
FROM (SELECT * FROM flagged)""")
def public_items(spark, sf):
    s = sightings(spark, sf).withColumn("caption", F.col("pos").cast("string"))
    return R.public_item(s).select("inv_id", F.col("snippet").cast("bigint").alias("pos"), "date_text",
                                   F.col("visual.verdict").alias("verdict"), "confidence", "is_upper_bound", "domain")


SIMILAR_SQL = f"""
WITH {SCORED_SQL},
st AS (SELECT inv_id, canonical, CASE WHEN (pos // 2) % 3 = 0 THEN 'page' ELSE 'none' END AS lvl FROM merged WHERE (pos // 2) % 2 = 0),
op AS (SELECT s.*, st.lvl FROM scored s LEFT JOIN st USING (inv_id, canonical)
  WHERE coalesce(st.lvl, 'none') = 'none' AND (first_thumb <> '' OR thumbs <> '')),
n AS (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY
  CASE match WHEN 'exact' THEN 0 WHEN 'page' THEN 1 WHEN 'similar' THEN 2 WHEN 'text' THEN 3 ELSE 9 END,
  CASE WHEN date_hint = '' THEN '9999' ELSE date_hint END, pos) AS similar_rank FROM op),
sim AS (SELECT * FROM n)"""


def _page_sightings(merged):
    no = F.floor(F.col("pos") / 2)
    return merged.filter(no % 2 == 0).select(
        "inv_id", "pos", "canonical", F.struct(F.when(no % 3 == 0, "page").otherwise("none").alias("level")).alias("image"),
        F.struct(F.lit(None).cast("timestamp").alias("when")).alias("date"))


@query(SIMILAR_SQL + """
SELECT inv_id, canonical, CASE WHEN title = '' THEN domain ELSE title END AS title, match AS match_type, lvl IS NOT NULL AS checked,
  CASE WHEN date_hint = '' THEN 'بدون تاريخ' ELSE substr(date_hint, 1, 10) END AS date_text, similar_rank FROM sim""")
def similar_rows(spark, sf):
    merged = C.merge_candidates(page_rows(spark, sf))
    s = R.similar_rows(merged, _page_sightings(merged), as_of())
    return s.select("inv_id", "canonical", "title", "match_type", "checked", "date_text", "similar_rank")


@query(SIMILAR_SQL + """,
c AS (SELECT inv_id, count(*) AS checked, count(*) FILTER (lvl = 'page') AS visually_confirmed, count(*) FILTER (lvl = 'none') AS visually_rejected FROM st GROUP BY 1),
d AS (SELECT inv_id, count(DISTINCT canonical) AS candidates FROM merged GROUP BY 1), k AS (SELECT inv_id, count(*) AS n_sim FROM sim GROUP BY 1)
SELECT inv_id, checked, visually_confirmed, visually_rejected, candidates, coalesce(n_sim, 0) AS "similar" FROM c JOIN d USING (inv_id) LEFT JOIN k USING (inv_id)""")
def run_stats(spark, sf):
    merged = C.merge_candidates(page_rows(spark, sf))
    s = _page_sightings(merged)
    stats = R.run_stats(s, merged, R.similar_rows(merged, s, as_of()))
    return stats.select("inv_id", "checked", "visually_confirmed", "visually_rejected", "candidates", "similar")


@query("""
SELECT 'inv' || (page_id % 7) AS inv_id, CASE page_id % 6 WHEN 0 THEN 'X' WHEN 1 THEN 'Instagram' WHEN 2 THEN 'YouTube' WHEN 4 THEN 'Telegram' ELSE 'ويب' END AS facet,
  count(*) AS n FROM pages GROUP BY ALL""")
def platform_facets(spark, sf):
    inv = F.concat(F.lit("inv"), F.col("page_id") % 7)
    return R.facet_counts(_social(spark, sf).select(inv.alias("inv_id"), F.col("url").alias("link")))


@query("""
WITH f AS (SELECT page_id, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS shown_rank FROM pages WHERE page_id % 6 = 0)
SELECT page_id, shown_rank FROM f WHERE shown_rank <= 24""")
def facet_page(spark, sf):
    inv = F.concat(F.lit("inv"), F.col("page_id") % 7)
    s = _social(spark, sf).select(inv.alias("inv_id"), F.col("page_id").alias("pos"), F.col("url").alias("link"))
    return R.facet_page(s, "X").select(F.col("pos").alias("page_id"), "shown_rank")


@query(f"""
WITH {SIGHTINGS_SQL}
SELECT inv_id, arg_min(url, (when_at, pos)) FILTER (when_at IS NOT NULL) AS first_url,
  strftime(min(when_at), '%Y-%m-%d %H:%M:%S') AS first_published_at, count(*) AS checked, count(when_at) AS with_dates FROM flagged GROUP BY 1""")
def timeline_v1(spark, sf):
    items = sightings(spark, sf).select("inv_id", "pos", "url", iso(F.col("date.when")).alias("published_at"))
    return R.timeline_v1(items)[1]


@query(f"""
WITH c AS (SELECT page_id, {canonical_sql('url')} AS canonical FROM pages)
SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'pass' WHEN page_id % 5 = 1 THEN 'acceptable' ELSE 'fail' END AS verdict FROM c""")
def bench_verdict(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("expected"))
    k = F.col("id") % 5
    cases = p.select("id", "expected", F.array(F.concat(F.lit("https://other.example/"), F.col("id"))).alias("acceptable"))
    results = p.select("id", F.when(k == 0, F.concat(F.substring_index("expected", "#", 1), F.lit("#frag")))
                       .when(k == 1, F.concat(F.lit("http://other.example/"), F.col("id"), F.lit("/?utm_x=1")))
                       .when(k == 2, F.lit("https://wrong.example/z")).alias("origin_url"))
    return R.bench_verdicts(cases, results).select("id", "verdict")


@query("""
SELECT doc_id AS id FROM labels WHERE (CASE WHEN toxic = 1 THEN 0 ELSE quality * 2 END) < (CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END)""")
def bench_regressions(spark, sf):
    l = table(spark, sf, "labels")
    now = l.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"))
    before = l.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "pass").otherwise("acceptable").alias("verdict"))
    return R.bench_regressions(now, before).select("id")


@query("""
SELECT 'c' || o_custkey AS inv_id, coalesce(max(CASE WHEN o_custkey % 3 = 0 THEN 9 END),
  count(DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'lens_exact_en' WHEN 1 THEN 'lens_visual' WHEN 2 THEN 'lens_exact_en@small' ELSE 'lens_visual@small' END)) AS credits
FROM orders GROUP BY o_custkey""")
def bench_credits(spark, sf):
    a = _answers(spark, sf)
    runs = table(spark, sf, "orders").select("o_custkey").distinct().select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("inv_id"), F.when(F.col("o_custkey") % 3 == 0, 9).cast("bigint").alias("credits"))
    return R.bench_credits(runs, C.engine_brief(a)).select("inv_id", "credits")
