"""How the driver's tables are read as provenance data, once as Spark and once as SQL text.

Nothing is invented beyond the columns: a page row is a candidate, an order line is a sighting, an event
is a metered call. Both sides state the same mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.urls import DROPPED_QUERY_PREFIXES, LISTING_PATTERN
from sightline.plans.registry import table

AS_OF = "2024-01-01 00:00:00"
CALLS_AS_OF = "2024-01-31 00:00:00"


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


# ------------------------------------------------------------------------------------------ pages
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidate rows per page: the link as it is, and the same link with tracking parameters
    reported by another engine. Every seventh page id shares an investigation."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    tracked = F.concat(
        F.substring_index("url", "#", 1),
        F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=mail&fbclid=x1"),
    )
    copies = F.array(
        F.struct(F.lit(0).alias("copy_no"), F.col("url").alias("url")),
        F.struct(F.lit(1).alias("copy_no"), tracked.alias("url")),
    )
    rows = p.select(pid, F.inline(copies))
    turn = pid + F.col("copy_no")
    return rows.select(
        F.concat(F.lit("inv"), pid % 7).alias("inv_id"),
        (pid * 2 + F.col("copy_no")).alias("pos"), "url",
        F.when(pid % 5 == 0, "").otherwise(F.concat(F.lit("Page "), pid)).alias("title"),
        F.when(turn % 3 == 0, None).otherwise(
            F.concat(F.lit("https://thumb.example/"), pid, F.lit("-"), F.col("copy_no"), F.lit(".jpg"))
        ).alias("thumb"),
        F.when(pid % 4 == 0, F.concat(F.lit("https://img.example/"), pid, F.lit(".png"))).alias("image_url"),
        F.when(turn % 3 == 0, "lens_exact_en").when(turn % 3 == 1, "yandex").otherwise("tineye").alias("engine"),
        (turn % 3).cast("int").alias("copy_id"),
        F.when(turn % 4 == 0, "exact").when(turn % 4 == 1, "similar").when(turn % 4 == 2, "page")
        .otherwise("text").alias("match"),
        F.when((pid % 6 == 0) & (F.col("copy_no") == 1), "2020-01-02").alias("crawl_date"),
        F.lit(None).cast("string").alias("first_indexed"),
        F.when(pid % 9 == 0, "12 May 2019").alias("engine_date"),
    )


_PREFIXES = "^(" + "|".join(DROPPED_QUERY_PREFIXES) + ")"
_LISTING = LISTING_PATTERN.replace("(?i)", "")


def canonical_sql(url: str) -> str:
    """The identity rule for plain links, in SQL."""
    host = f"lower(regexp_extract({url}, '^https?://([^/?#:]+)', 1))"
    path = f"regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1)"
    query = f"regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1)"
    kept = (
        f"array_to_string(list_sort(list_filter(string_split({query}, '&'), "
        f"lambda x: contains(x, '=') AND split_part(x, '=', 2) <> '' "
        f"AND NOT regexp_matches(lower(split_part(x, '=', 1)), '{_PREFIXES}'))), '&')"
    )
    return (
        f"('https://' || {host} || CASE WHEN {path} = '' THEN '/' WHEN length({path}) > 1 "
        f"THEN regexp_replace({path}, '/+$', '') ELSE {path} END || "
        f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"
    )


def listing_sql(canonical: str) -> str:
    return f"regexp_matches(regexp_replace({canonical}, '^https://[^/?]*', ''), '(?i){_LISTING}')"


HOST_SQL = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"

PAGE_ROWS_SQL = f"""
raw_rows AS (
  SELECT page_id, c AS copy_no,
         CASE WHEN c = 0 THEN url ELSE split_part(url, '#', 1) ||
              CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=mail&fbclid=x1' END AS url
  FROM pages, (SELECT unnest([0, 1]) AS c)),
page_rows AS (
  SELECT 'inv' || (page_id % 7) AS inv_id, page_id * 2 + copy_no AS pos, url,
         {canonical_sql('url')} AS canonical, {HOST_SQL} AS host,
         CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Page ' || page_id END AS title,
         CASE WHEN (page_id + copy_no) % 3 = 0 THEN NULL
              ELSE 'https://thumb.example/' || page_id || '-' || copy_no || '.jpg' END AS thumb,
         CASE WHEN page_id % 4 = 0 THEN 'https://img.example/' || page_id || '.png' END AS image_url,
         CASE (page_id + copy_no) % 3 WHEN 0 THEN 'lens_exact_en' WHEN 1 THEN 'yandex' ELSE 'tineye' END AS engine,
         CAST((page_id + copy_no) % 3 AS INTEGER) AS copy_id,
         CASE (page_id + copy_no) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'similar' WHEN 2 THEN 'page' ELSE 'text' END AS match,
         CASE WHEN page_id % 6 = 0 AND copy_no = 1 THEN '2020-01-02' END AS crawl_date,
         CASE WHEN page_id % 9 = 0 THEN '12 May 2019' END AS engine_date
  FROM raw_rows)"""

MATCH_RANK_SQL = "CASE match WHEN 'exact' THEN 0 WHEN 'text' THEN 1 WHEN 'page' THEN 2 WHEN 'similar' THEN 3 ELSE 9 END"

MERGED_SQL = PAGE_ROWS_SQL + f""",
engine_firsts AS (
  SELECT inv_id, canonical, engine, min(pos) AS p FROM page_rows GROUP BY ALL),
engine_lists AS (
  SELECT inv_id, canonical, string_agg(engine, ',' ORDER BY p) AS engines, count(*) AS n_engines
  FROM engine_firsts GROUP BY ALL),
thumb_rows AS (
  SELECT inv_id, canonical, pos * 2 AS slot, image_url AS thumb FROM page_rows WHERE image_url IS NOT NULL
  UNION ALL SELECT inv_id, canonical, pos * 2 + 1, thumb FROM page_rows WHERE thumb IS NOT NULL),
thumb_firsts AS (
  SELECT inv_id, canonical, thumb, min(slot) AS slot FROM thumb_rows GROUP BY ALL),
thumb_lists AS (
  SELECT inv_id, canonical, string_agg(thumb, ',' ORDER BY slot, thumb) AS thumbs
  FROM thumb_firsts GROUP BY ALL),
merged_core AS (
  SELECT inv_id, canonical, min(pos) AS pos, arg_min(url, pos) AS url, arg_min(host, pos) AS host,
         arg_min(match, {MATCH_RANK_SQL} * 1000000000000 + pos) AS match,
         string_agg(DISTINCT copy_id, ',' ORDER BY copy_id) AS copy_ids,
         coalesce(arg_min(title, pos) FILTER (title <> ''), '') AS title,
         arg_min(crawl_date, pos) FILTER (crawl_date IS NOT NULL) AS crawl_date,
         arg_min(engine_date, pos) FILTER (engine_date IS NOT NULL) AS engine_date,
         coalesce(arg_min(coalesce(thumb, ''), pos), '') AS first_thumb
  FROM page_rows GROUP BY ALL),
merged AS (
  SELECT m.*, e.engines, e.n_engines, coalesce(t.thumbs, '') AS thumbs
  FROM merged_core m JOIN engine_lists e USING (inv_id, canonical)
  LEFT JOIN thumb_lists t USING (inv_id, canonical))"""

SCORED_SQL = MERGED_SQL + f""",
scored AS (
  SELECT *, CASE match WHEN 'exact' THEN 0 WHEN 'text' THEN 15 WHEN 'page' THEN 20 WHEN 'similar' THEN 30 ELSE 40 END
            - 5 * least(n_engines, 3) - CASE WHEN crawl_date IS NOT NULL THEN 6 ELSE 0 END
            + CASE WHEN {listing_sql('canonical')} THEN 40 ELSE 0 END AS score,
         CASE WHEN engine_date IS NOT NULL THEN '2019-05-12T00:00:00Z' ELSE '' END AS date_hint,
         regexp_replace(host, '^www[.]', '') AS domain
  FROM merged)"""


# --------------------------------------------------------------------------------------- sightings
def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sightings: an order is an investigation, the supplier is the site."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
        "l_extendedprice",
    )
    level = F.when(F.col("l_returnflag") == "R", "page").when(F.col("l_returnflag") == "A", "platform").when(
        F.col("l_linestatus") == "F", "engine_claim").otherwise("none")
    date_level = F.when(F.col("l_partkey") % 4 == 0, "platform_id").when(F.col("l_partkey") % 4 == 1, "structured").when(
        F.col("l_partkey") % 4 == 2, "weak").otherwise("none")
    url = F.concat(
        F.lit("https://s"), F.col("l_suppkey"), F.lit(".example/"),
        F.when(F.col("l_linenumber") == 7, "tag/").otherwise(""), F.col("l_partkey"),
    )
    when = F.when(date_level != "none", F.col("l_shipdate") + F.make_interval(hours=(F.col("l_suppkey") % 24).cast("int")))
    return li.select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("inv_id"),
        (F.col("l_linenumber").cast("bigint") * 100000000000000000 + F.col("l_partkey") % 100000 * 1000000000000
         + F.col("l_suppkey") % 10000 * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("pos"),
        url.alias("url"), url.alias("canonical"), F.concat(F.lit("T"), F.col("l_partkey") % 50).alias("title"),
        F.lit(None).cast("string").alias("caption"),
        F.struct(
            level.alias("level"),
            F.when(level != "none", F.when(F.col("l_linenumber") % 2 == 0, "exact").otherwise("variant")).alias("kind"),
            F.lit(None).cast("string").alias("matched_url"), F.lit(None).cast("int").alias("phash"),
            F.lit(None).cast("string").alias("note"), (F.col("l_linenumber") % 3).cast("int").alias("frame"),
        ).alias("image"),
        F.struct(
            date_level.alias("level"), when.alias("when"),
            F.when(F.col("l_partkey") % 8 == 3, F.col("l_shipdate")).alias("upper_bound"),
            F.array().cast("array<struct<source:string,date:timestamp,confidence:double>>").alias("sources"),
        ).alias("date"),
        F.lit("exact").alias("match"), F.array(F.lit("lens_exact_en")).alias("engines"),
        F.array().cast("array<string>").alias("thumbs"), F.array(F.lit(1)).alias("copy_ids"), F.lit(1).alias("round"),
        (F.col("l_linenumber") == 7).alias("is_listing"),
    )


SIGHTINGS_SQL = """
sight0 AS (
  SELECT 'o' || l_orderkey AS inv_id,
         CAST(l_linenumber AS BIGINT) * 100000000000000000 + l_partkey % 100000 * 1000000000000
         + l_suppkey % 10000 * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS pos,
         'https://s' || l_suppkey || '.example/' || CASE WHEN l_linenumber = 7 THEN 'tag/' ELSE '' END || l_partkey AS url,
         'T' || (l_partkey % 50) AS title, l_linenumber = 7 AS is_listing,
         CASE WHEN l_returnflag = 'R' THEN 'page' WHEN l_returnflag = 'A' THEN 'platform'
              WHEN l_linestatus = 'F' THEN 'engine_claim' ELSE 'none' END AS image_level,
         CASE WHEN l_linenumber % 2 = 0 THEN 'exact' ELSE 'variant' END AS kind0,
         l_linenumber % 3 AS frame,
         CASE l_partkey % 4 WHEN 0 THEN 'platform_id' WHEN 1 THEN 'structured' WHEN 2 THEN 'weak' ELSE 'none' END AS date_level,
         l_shipdate + to_hours(CAST(l_suppkey % 24 AS INTEGER)) AS when0,
         CASE WHEN l_partkey % 8 = 3 THEN l_shipdate END AS upper_bound
  FROM lineitem),
sight AS (
  SELECT *, CASE WHEN image_level = 'none' THEN NULL ELSE kind0 END AS kind,
         CASE WHEN date_level = 'none' THEN NULL ELSE when0 END AS when_at,
         CASE date_level WHEN 'platform_id' THEN 3 WHEN 'structured' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS lvl
  FROM sight0),
flagged AS (
  SELECT *, image_level IN ('platform', 'page') AND date_level IN ('platform_id', 'structured')
            AND when_at IS NOT NULL AND NOT is_listing AS ok
  FROM sight)"""

ORDER_SQL = "when_at IS NULL, CAST(when_at AS DATE), -lvl, when_at, pos"


# ------------------------------------------------------------------------------------------- calls
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metered service calls of eight providers."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 8).alias("provider"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status_code"),
        F.col("ts").alias("created_at"), F.concat(F.lit("user:"), F.col("user_id")).alias("caller"), "user_id",
    )


CALLS_SQL = """
calls AS (
  SELECT event_id AS id, 'p' || (user_id % 8) AS provider, event_type <> 'error' AS ok, value AS latency_ms,
         ts AS created_at, 'user:' || user_id AS caller, user_id,
         CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status_code
  FROM events)"""
