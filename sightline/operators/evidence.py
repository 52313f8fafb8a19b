"""Dating a page: gather evidence, resolve it against upper bounds, grade it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import dates, html as H, urls
from sightline.functions.columns import blank_to_null, first_nonblank, let

# --- Fixed values ----------------------------------------------------------------------------------
CORROBORATION = 0.04
TOP_CONFIDENCE = 0.99
FIRST_CLASS = 0.9
BOUND_CONFIDENCE = 0.6
CRAWL_BOUND_CONFIDENCE = 0.75
TWEET_CONFIDENCE = 0.98
ARCHIVE_PREFIX = "https://web.archive.org/web/"
# (attribute, value, evidence name, confidence) of the earlier, first-hit order
V1_META = (
    ("property", "og:published_time", "meta:og:published_time", 0.85),
    ("property", "article:published", "meta:article:published", 0.85),
    ("name", "pubdate", "meta:pubdate", 0.80),
    ("name", "publishdate", "meta:publishdate", 0.80),
    ("name", "date", "meta:date", 0.75),
    ("itemprop", "datePublished", "meta:datePublished", 0.80),
    ("name", "article.published", "meta:article.published", 0.80),
)
V1_FORMATS = (
    (r"^[A-Za-z0-9]+ [A-Za-z]+ \d{4}$", ("d MMMM yyyy", "d MMM yyyy")),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", ("MMMM d, yyyy", "MMM d, yyyy")),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("d-M-yyyy", "M-d-yyyy")),
    (r"^\d{8}$", ("yyyyMMdd",)),
)
V1_TEXT_PATTERNS = (
    r"\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", r"\b(\d{4}-\d{2}-\d{2})", r"\b(\d{1,2}/\d{1,2}/\d{4})",
)
# ---------------------------------------------------------------------------------------------------

_NONE = f"array<{dates.EVIDENCE}>"


def _day(date: Column) -> Column:
    return F.to_date(date)


def _prefix(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def _settle(best, corroborated: Column, rank: Column, bound, has_best: Column, has_bound: Column) -> Column:
    """The verdict from the best claim, its corroboration and the earliest bound."""
    trust = F.when(
        corroborated, F.least(F.lit(TOP_CONFIDENCE), best["confidence"] + CORROBORATION)
    ).otherwise(best["confidence"])
    late = has_best & has_bound & (best["date"] > bound["date"]) & (trust < FIRST_CLASS)
    alone = ~has_best & has_bound
    return F.struct(
        F.when(late | alone, bound["date"]).otherwise(best["date"]).alias("published_at"),
        F.when(late, F.greatest(bound["confidence"], F.lit(BOUND_CONFIDENCE)))
        .when(alone, bound["confidence"]).when(has_best, trust).otherwise(0.0).alias("confidence"),
        (late | alone).alias("is_upper_bound"),
        bound["date"].alias("bound_at"),
        F.when(late | alone | ~has_best, 0).otherwise(rank).alias("level_rank"),
    )


def resolve(evidence: Column, bounds: Column) -> Column:
    """Row-local resolve of ``array<evidence>`` and ``array<evidence>`` upper bounds: no shuffle.

    Highest confidence wins, ties go to the earliest date; two independent kinds of source on that day
    raise the trust; an earlier bound beats a claim that is not first class.
    """
    def settle(both):
        ev, bd = both["ev"], both["bd"]
        best = F.array_min(F.transform(ev, lambda e: F.struct(
            (-e["confidence"]).alias("neg"), e["date"].alias("date"), e["confidence"].alias("confidence")
        )))
        bound = F.array_min(F.transform(bd, lambda b: F.struct(b["date"].alias("date"), b["confidence"].alias("confidence"))))

        def with_best(pair):
            top, low = pair["best"], pair["bound"]
            agreeing = F.filter(ev, lambda e: _day(e["date"]) == _day(top["date"]))
            kinds = F.size(F.array_distinct(F.transform(agreeing, lambda e: _prefix(e["source"]))))
            rank = F.array_max(F.transform(agreeing, lambda e: dates.level_rank(dates.level_of(e["source"]))))
            return _settle(top, kinds >= 2, rank, low, top.isNotNull(), low.isNotNull())

        return let(F.struct(best.alias("best"), bound.alias("bound")), with_best)

    def dated(a):
        return F.filter(F.coalesce(a, F.array().cast(_NONE)), lambda e: e["date"].isNotNull())

    return let(F.struct(dated(evidence).alias("ev"), dated(bounds).alias("bd")), settle)


def resolve_rows(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resolve of a long evidence table (``keys..., kind, date, confidence, source``; kind is
    ``evidence`` or ``bound``). Three combining aggregations, each on the output of the one before, so a
    page that owns a large share of the rows is folded map-side and never collected.
    """
    keys = list(keys)
    claim = F.when(F.col("date").isNotNull(), F.struct(
        (-F.col("confidence")).alias("neg"), F.col("date"), F.col("confidence")
    ))
    per_source = evidence.groupBy(
        *keys, "kind", _day(F.col("date")).alias("day"), _prefix(F.col("source")).alias("prefix")
    ).agg(
        F.min(claim).alias("best"), F.min(F.struct("date", "confidence")).alias("low"),
        F.max(dates.level_rank(dates.level_of(F.col("source")))).alias("rank"),
    )
    per_day = per_source.groupBy(*keys, "kind", "day").agg(
        F.min("best").alias("best"), F.count(F.lit(1)).alias("kinds"), F.max("rank").alias("rank"),
        F.min("low").alias("low"),
    )
    is_claim = (F.col("kind") == "evidence") & F.col("day").isNotNull()
    is_bound = (F.col("kind") == "bound") & F.col("day").isNotNull()
    pages = per_day.groupBy(*keys).agg(
        F.min(F.when(is_claim, F.struct("best", "kinds", "rank"))).alias("c"),
        F.min(F.when(is_bound, F.col("low"))).alias("b"),
    )
    verdict = _settle(
        F.col("c.best"), F.col("c.kinds") >= 2, F.col("c.rank"), F.col("b"),
        F.col("c").isNotNull(), F.col("b").isNotNull(),
    )
    return pages.select(*keys, verdict.alias("r")).select(*keys, "r.*")


def grade(resolved: Column, listing: Column) -> Column:
    """``struct<level, when, upper_bound>``: a bound is never the date; a listing is at most weak."""
    when = F.when(~resolved["is_upper_bound"], resolved["published_at"])
    level = F.when(when.isNull(), "none").when(
        listing & (resolved["level_rank"] != dates.LEVEL_RANKS["platform_id"]), "weak"
    ).otherwise(dates.level_from_rank(resolved["level_rank"]))
    return F.struct(
        level.alias("level"), when.alias("when"),
        F.when(resolved["is_upper_bound"], resolved["published_at"]).otherwise(resolved["bound_at"]).alias("upper_bound"),
    )


def page_evidence(
    url: Column, html: Column, last_modified: Column, tweet_created_at: Column, as_of: Column,
    extra: Column | None = None,
) -> Column:
    """All date evidence of one landed page as ``array<evidence>``, in gathering order."""
    tweet = dates.evidence(dates.parse_date(tweet_created_at, as_of), TWEET_CONFIDENCE, "platform:tweet_time")
    none = F.array().cast(_NONE)
    return F.concat(
        F.array_compact(F.array(dates.platform_date(url, as_of), tweet)),
        F.coalesce(extra, none) if extra is not None else F.array_compact(
            F.array(dates.platform_page_date(url, html, as_of))
        ),
        F.when(html != "", H.html_date_evidence(html, as_of)).otherwise(none),
        F.array_compact(F.array(dates.header_date(last_modified, as_of))),
    )


def crawl_bound(crawl_date: Column, as_of: Column) -> Column:
    return F.array_compact(F.array(
        dates.evidence(dates.parse_date(crawl_date, as_of), CRAWL_BOUND_CONFIDENCE, "tineye:crawl_date")
    ))


def strongest_sources(evidence: Column, n: int | None = None) -> Column:
    """The evidence values, strongest first, or the ``n`` strongest; equals keep gathering order."""
    numbered = F.transform(evidence, lambda e, i: F.struct(
        (-e["confidence"]).alias("neg"), i.alias("i"), e.alias("e")
    ))
    ordered = F.array_sort(numbered)
    return F.transform(ordered if n is None else F.slice(ordered, 1, n), lambda x: x["e"])


def date_pages(pages: DataFrame, as_of: Column) -> DataFrame:
    """Dates every landed page in one pass over its row: evidence, resolve, level. No shuffle.

    Input columns: ``url, html, last_modified, tweet_created_at, crawl_date`` (plus any keys). Adds
    ``evidence`` and ``date struct<level, when, upper_bound, sources>``.
    """
    ev = pages.withColumn("evidence", page_evidence(
        F.col("url"), F.col("html"), F.col("last_modified"), F.col("tweet_created_at"), as_of
    ))
    resolved = ev.withColumn("_resolved", resolve(F.col("evidence"), crawl_bound(F.col("crawl_date"), as_of)))
    known = urls.with_url_identity(resolved.withColumn("_url", F.col("url")), "_url")
    graded = known.withColumn("_date", grade(F.col("_resolved"), F.col("is_listing"))).drop(
        "_url", *[c for c in urls.IDENTITY_COLUMNS if c not in pages.columns])
    return graded.withColumn("date", F.struct(
        F.col("_date.level"), F.col("_date.when"), F.col("_date.upper_bound"),
        strongest_sources(F.col("evidence")).alias("sources"),
    )).drop("_resolved", "_date")


# ------------------------------------------------------------------------------------------ captures

def earliest_capture(captures: DataFrame) -> DataFrame:
    """First successful archive capture per link. ``captures``: ``url, timestamp`` (14 digits), ``statuscode``."""
    good = captures.filter(
        F.col("statuscode").cast("string").rlike("^[23]..$") & (F.substring("timestamp", 1, 4) >= "1996")
    )
    return good.groupBy("url").agg(F.min("timestamp").alias("capture")).withColumn(
        "captured_at", F.try_to_timestamp("capture", F.lit("yyyyMMddHHmmss"))
    )


def archive_links(origins: DataFrame, captures: DataFrame) -> DataFrame:
    """An archived copy of each origin: the capture when one exists, else the wildcard page, marked failed."""
    found = origins.join(earliest_capture(captures).select("url", "capture"), "url", "left")
    has = F.col("capture").isNotNull()
    return found.withColumn("archived", F.struct(
        F.concat(F.lit(ARCHIVE_PREFIX), F.coalesce("capture", F.lit("*")), F.lit("/"), F.col("url")).alias("url"),
        F.when(has, "existing").otherwise("failed").alias("status"),
    )).drop("capture")


def bounds_from_captures(captures: DataFrame, confidence: float = CRAWL_BOUND_CONFIDENCE) -> DataFrame:
    """Captures as upper-bound rows for :func:`resolve_rows`."""
    return earliest_capture(captures).select(
        "url", F.lit("bound").alias("kind"), F.col("captured_at").alias("date"),
        F.lit(confidence).alias("confidence"), F.lit("wayback:first_capture").alias("source"),
    )


# ------------------------------------------------------------------------------- earlier first-hit order

def parse_date_v1(value: Column) -> Column:
    """The earlier, laxer reader: no plausibility test, month before day in slashed dates, and a date
    found anywhere in the text as the last try."""
    def read(text):
        named = F.initcap(text)
        tries = None
        for shape, formats in V1_FORMATS:
            found = F.coalesce(*[F.try_to_timestamp(named, F.lit(f)) for f in formats])
            tries = F.when(text.rlike(shape), found) if tries is None else tries.when(text.rlike(shape), found)
        iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})?)?$"
        # The zone of an ISO string is read but not applied, as in the stored form.
        whole = F.when(text.rlike(iso), F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp"))
        inside = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("timestamp")
        return F.coalesce(whole, tries, inside)

    return let(F.trim(value), read)


def first_hit_date(url: Column, html: Column) -> Column:
    """The earlier waterfall: the first place that yields a date decides.

    ``struct<published_at, confidence, evidence>``; places in order: article:published_time, JSON-LD,
    ten selectors, the path, the opening text.
    """
    def hit(value, confidence, name):
        return let(parse_date_v1(value), lambda d: F.when(d.isNotNull(), F.struct(
            F.date_trunc("second", d).alias("published_at"), F.lit(float(confidence)).alias("confidence"),
            F.lit(name).alias("evidence"),
        )))

    stated = F.transform(H.jsonld_objects(html), lambda item: parse_date_v1(F.coalesce(*[
        blank_to_null(F.try_variant_get(item, f"$.{key}", "string"))
        for key in ("datePublished", "dateCreated", "uploadDate")
    ])))
    jsonld = F.when(html.contains("application/ld+json"), F.get(F.array_compact(stated), F.lit(0)))
    jsonld = let(jsonld, lambda d: F.when(d.isNotNull(), F.struct(
        F.date_trunc("second", d).alias("published_at"), F.lit(0.90).alias("confidence"),
        F.lit("jsonld:datePublished").alias("evidence"),
    )))
    path = F.concat_ws("-", *[
        F.lpad(F.regexp_extract(url, r"/(\d{4})/(\d{1,2})/(\d{1,2})/", i), n, "0") for i, n in ((1, 4), (2, 2), (3, 2))
    ])
    in_path = F.when(url.rlike(r"/\d{4}/\d{1,2}/\d{1,2}/"), path)

    def time_value(times, with_attribute):
        fit = F.filter(times, lambda t: t.rlike(rf"(?is)^<[^>]*\s{with_attribute}(?=[\s=/>])"))
        return let(F.get(fit, F.lit(0)), lambda t: first_nonblank(
            H.attribute(t, "datetime"), F.regexp_extract(t, r"(?s)>(.*)$", 1)))

    def item_value(body):
        tag = F.regexp_extract(body, r"(?is)(<[a-z][a-z0-9]*\s[^<>]*itemprop\s*=\s*[\"']?datePublished[^<]*)", 1)
        return let(tag, lambda t: first_nonblank(
            H.attribute(t, "content"), H.attribute(t, "datetime"), F.regexp_extract(t, r"(?s)>(.*)$", 1)))

    def walk(body):
        times = H.tags(body, "time")
        return F.coalesce(
            hit(H.meta_content(body, "article:published_time"), 0.95, "meta:article:published_time"),
            jsonld,
            *[hit(H.meta_content(body, value, (attr,)), conf, name) for attr, value, name, conf in V1_META],
            hit(time_value(times, "datetime"), 0.75, "time:datetime"),
            hit(time_value(times, "pubdate"), 0.75, "time:pubdate"),
            hit(item_value(body), 0.70, "itemprop:datePublished"),
            hit(in_path, 0.65, "url:path_date"),
            let(H.visible_text(body, stripped=True), lambda t: F.coalesce(*[
                hit(blank_to_null(F.regexp_extract(t, p, 1)), 0.50, "text:pattern_match") for p in V1_TEXT_PATTERNS
            ])),
        )

    return let(H.without_code(html), walk)
