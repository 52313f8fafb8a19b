"""Date decoding and parsing as native Column expressions.

Everything that depends on the clock takes ``as_of`` (a timestamp Column) instead of reading "now".
Evidence is ``struct<date timestamp, confidence double, source string>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions import urls
from sightline.functions.columns import let

# --- Fixed values ----------------------------------------------------------------------------------
X_EPOCH_MS = 1288834974657
INSTAGRAM_EPOCH_MS = 1314220021721
SHORTCODE_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
EARLIEST_YEAR = 1995
EARLIEST_PLATFORM_YEAR = 2005
FRESH_HOURS = 36
FRESH_CONFIDENCE = 0.3
LEVEL_RANKS = {"platform_id": 3, "structured": 2, "weak": 1, "none": 0}
LEVEL_CONFIDENCE = {"platform_id": 0.98, "structured": 0.9, "weak": 0.4}
EVIDENCE = "struct<date:timestamp,confidence:double,source:string>"
# ---------------------------------------------------------------------------------------------------

_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
_SPACES = " \t\n\r\f\u000b "


def evidence(date: Column, confidence, source) -> Column:
    """One evidence value; null when the date is null."""
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    src = source if isinstance(source, Column) else F.lit(source)
    return let(date, lambda d: F.when(
        d.isNotNull(),
        F.struct(
            F.date_trunc("second", d).alias("date"), conf.cast("double").alias("confidence"), src.alias("source")
        ),
    ))


def plausible(date: Column, as_of: Column, earliest_year: int = EARLIEST_YEAR) -> Column:
    return (F.year(date) >= earliest_year) & (date <= as_of + F.expr("INTERVAL 1 DAY"))


def keep_plausible(date: Column, as_of: Column, earliest_year: int = EARLIEST_YEAR) -> Column:
    return let(date, lambda d: F.when(plausible(d, as_of, earliest_year), d))


def to_iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _parse_text(text: Column) -> Column:
    """A loosely written date to a UTC timestamp. One shape test picks the one pattern that can fit."""
    named = F.initcap(text)
    no_weekday = F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+", "")

    def with_month(before: str, after: str) -> Column:
        return F.coalesce(
            F.try_to_timestamp(named, F.lit(f"{before}MMMM{after}")),
            F.try_to_timestamp(named, F.lit(f"{before}MMM{after}")),
        )

    iso = F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.when(text.rlike(_ISO), iso.try_cast("timestamp")))
        .when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(text.try_cast("bigint")))
        .when(text.rlike(r"^\d{13}$"), F.timestamp_millis(text.try_cast("bigint")))
        .when(text.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), with_month("d ", " yyyy"))
        .when(text.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), with_month("", " d, yyyy"))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy/M/d")))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("d/M/yyyy")))
        .when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(
            text.rlike(r"^[A-Za-z]{3,9}, \d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC)$"),
            F.try_to_timestamp(F.regexp_replace(no_weekday, r" (GMT|UTC)$", ""), F.lit("d MMM yyyy HH:mm:ss")),
        )
        .when(
            text.rlike(r"^[A-Za-z]{3} [A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$"),
            F.try_to_timestamp(no_weekday, F.lit("MMM d HH:mm:ss Z yyyy")),
        )
    )


def parse_date(value: Column, as_of: Column) -> Column:
    """Loose string to a plausible UTC timestamp, or null."""
    text = F.trim(value, F.lit(_SPACES))
    return keep_plausible(let(text, _parse_text), as_of)


# ------------------------------------------------------------------------------- dates in post ids

def x_post_date(url: Column, as_of: Column) -> Column:
    """Creation time carried by an X post id. Ids beyond 63 bits would lie decades ahead: null."""
    post = F.regexp_extract(urls.path_of(url), r"/status(?:es)?/(\d{15,20})", 1).try_cast("bigint")
    on_host = urls.netloc_of(url).rlike(r"twitter\.com|x\.com|nitter")
    date = F.timestamp_millis(F.shiftright(post, 22) + F.lit(X_EPOCH_MS))
    return evidence(
        F.when(on_host, keep_plausible(date, as_of, EARLIEST_PLATFORM_YEAR)), 0.98, "platform:twitter_snowflake"
    )


def shortcode_millis(code: Column) -> Column:
    """Milliseconds held in the top bits of an Instagram shortcode (its first 11 characters).

    Dropping the last three base-64 digits drops 18 of the 23 low bits, which leaves a number of at
    most 48 bits: plain bigint arithmetic is enough, no 66-bit decimal.
    """
    used = F.least(F.length(code), F.lit(11)) - 3
    number = F.lit(0).cast("bigint")
    for i in range(1, 9):
        digit = F.call_function("locate", F.substring(code, i, 1), F.lit(SHORTCODE_ALPHABET)) - 1
        inside = F.lit(i) <= used
        number = number * F.when(inside, F.lit(64)).otherwise(1) + F.when(inside, digit).otherwise(0)
    return F.shiftright(number, 5) + F.lit(INSTAGRAM_EPOCH_MS)


def instagram_post_date(url: Column, as_of: Column) -> Column:
    code = F.regexp_extract(urls.path_of(url), r"/(?:p|reel|reels|tv)/([A-Za-z0-9_-]{9,12})(?:/|$)", 1)
    on_host = urls.netloc_of(url).contains("instagram.com") & (code != "")
    date = F.timestamp_millis(shortcode_millis(code))
    return evidence(
        F.when(on_host, keep_plausible(date, as_of, EARLIEST_PLATFORM_YEAR)), 0.95, "platform:instagram_shortcode"
    )


def tiktok_post_date(url: Column, as_of: Column) -> Column:
    post = F.regexp_extract(urls.path_of(url), r"/video/(\d{17,20})", 1).try_cast("bigint")
    on_host = urls.netloc_of(url).contains("tiktok.com")
    date = F.timestamp_seconds(F.shiftright(post, 32))
    return evidence(
        F.when(on_host, keep_plausible(date, as_of, EARLIEST_PLATFORM_YEAR)), 0.95, "platform:tiktok_id"
    )


def platform_date(url: Column, as_of: Column) -> Column:
    """Date evidence carried by the post id in the link itself."""
    return F.when(
        urls.path_of(url).rlike(r"/status(?:es)?/\d{15}|/(?:p|reel|reels|tv)/[A-Za-z0-9_-]{9}|/video/\d{17}"),
        F.coalesce(x_post_date(url, as_of), instagram_post_date(url, as_of), tiktok_post_date(url, as_of)),
    )


def platform_page_date(url: Column, html: Column, as_of: Column) -> Column:
    """Date a platform's own landed page carries: Telegram time tag, Facebook creation epoch."""
    host = urls.netloc_of(url)
    message = host.isin("t.me", "telegram.me") & urls.path_of(url).rlike(r"^/[A-Za-z0-9_]+/\d+/?$")
    stamp = parse_date(F.regexp_extract(html, r'<time[^>]+datetime="([^"]+)"', 1), as_of)
    epoch = F.regexp_extract(html, r'"(?:creation_time|publish_time)":(\d{9,11})', 1).try_cast("bigint")
    created = keep_plausible(F.timestamp_seconds(epoch), as_of, EARLIEST_PLATFORM_YEAR)
    return F.when(message, evidence(stamp, 0.95, "platform:telegram_time")).when(
        host.contains("facebook.com"), evidence(created, 0.92, "platform:facebook_creation_time")
    )


def _date_of(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d"))


def url_path_date(url: Column, as_of: Column) -> Column:
    """Date written in the path: a full day, else a month (read as its first day)."""
    path = urls.path_of(url)
    slashed = r"/((?:19|20)\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)"
    dashed = r"/((?:19|20)\d{2})-(\d{2})-(\d{2})(?:[/-]|$)"
    month = r"/((?:19|20)\d{2})/(\d{1,2})(?:/|$)"

    def day_of(pattern):
        return _date_of(*[F.regexp_extract(path, pattern, i) for i in (1, 2, 3)])

    day = keep_plausible(
        F.when(path.rlike(slashed), day_of(slashed)).when(path.rlike(dashed), day_of(dashed)), as_of
    )
    first = F.when(
        path.rlike(month),
        keep_plausible(_date_of(F.regexp_extract(path, month, 1), F.regexp_extract(path, month, 2), F.lit("1")), as_of),
    )
    return F.coalesce(evidence(day, 0.65, "url:path_date"), evidence(first, 0.40, "url:path_month"))


def header_date(last_modified: Column, as_of: Column) -> Column:
    date = parse_date(last_modified, as_of)
    return evidence(F.when(date < as_of, date), 0.35, "http:last-modified")


# ------------------------------------------------------------------------------- small conversions

def cap_fresh(ev: Column, as_of: Column) -> Column:
    """A date of the last day and a half usually means "a live page": cap its confidence."""
    fresh = ev["date"] >= as_of - F.expr(f"INTERVAL {FRESH_HOURS} HOURS")
    return F.when(
        fresh,
        F.struct(
            ev["date"].alias("date"),
            F.least(ev["confidence"], F.lit(FRESH_CONFIDENCE)).alias("confidence"),
            F.concat(ev["source"], F.lit("?fresh")).alias("source"),
        ),
    ).otherwise(ev)


def level_of(source: Column) -> Column:
    s = F.lower(source)
    return (
        F.when(s.rlike("^(platform|api):"), "platform_id")
        .when(s.rlike("^(meta|jsonld|time):"), "structured")
        .otherwise("weak")
    )


def level_rank(level: Column) -> Column:
    out = None
    for name, rank in LEVEL_RANKS.items():
        out = F.when(level == name, rank) if out is None else out.when(level == name, rank)
    return out.otherwise(0)


def level_from_rank(rank: Column) -> Column:
    out = None
    for name, value in LEVEL_RANKS.items():
        out = F.when(rank == value, name) if out is None else out.when(rank == value, name)
    return out


def level_confidence(level: Column) -> Column:
    out = None
    for name, conf in LEVEL_CONFIDENCE.items():
        out = F.when(level == name, conf) if out is None else out.when(level == name, conf)
    return out


def capture_date(original: Column, digitized: Column, changed: Column, as_of: Column) -> Column:
    """When the photo was taken, from already extracted tag strings, in tag order."""
    def one(raw):
        return parse_date(F.regexp_replace(raw, r"^(\d{4}):(\d{2}):", "$1-$2-"), as_of)

    return F.date_trunc("second", F.coalesce(one(original), one(digitized), one(changed)))


def rfc3339(value: Column) -> Column:
    """Date or ISO date-time string to one with seconds and a zone."""
    v = F.trim(value, F.lit(_SPACES))
    tail = F.substring(v, 11, 1000)
    dashes = F.length(tail) - F.length(F.replace(tail, F.lit("-"), F.lit("")))
    return (
        F.when(F.length(v) == 10, F.concat(v, F.lit("T00:00:00Z")))
        .when(v.endswith("Z") | tail.contains("+") | (dashes == 1), v)
        .otherwise(F.concat(v, F.lit("Z")))
    )


def stored_timestamp(value: Column) -> Column:
    """ISO string to the zone-less timestamp a result row stores: the offset is dropped, not applied."""
    bare = F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.when(
        value.rlike(_ISO), F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value).otherwise(bare).try_cast("timestamp_ntz")
    )
