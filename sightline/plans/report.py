"""From sightings to the report: the earliest eligible sighting, timeline, leads, look-alikes, counts.

A sighting row is ``inv_id, pos, url, canonical, title, caption, image struct, date struct, match, engines,
thumbs, copy_ids, round``. Answers per investigation are aggregates (``min_by``), so a huge investigation
folds map-side; ordered lists are either a global sort or a ``row_number <= k`` with a group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import dates, urls
from sightline.functions.columns import blank_to_null
from sightline.operators.candidates import date_hint
from sightline.operators.skew import distinct_count, top_rows

# --- Fixed values ----------------------------------------------------------------------------------
ELIGIBLE_IMAGE = ("platform", "page")
ELIGIBLE_DATE = ("platform_id", "structured")
FACET_PAGE = 24
AT_LEAST_SINCE = "على الأقل منذ "
NO_DATE = "بدون تاريخ"
VERDICTS = {"platform": "confirmed", "page": "confirmed", "engine_claim": "ambiguous", "none": "unverified"}
BENCH_RANKS = {"pass": 2, "acceptable": 1, "fail": 0, "error": 0}
PAID_LABELS = r"^(lens|yandex|google_reverse|text)"
# ---------------------------------------------------------------------------------------------------


def _listing(df: DataFrame) -> Column:
    return F.col("is_listing") if "is_listing" in df.columns else urls.is_listing(F.col("url"))


def eligible(df: DataFrame) -> Column:
    """The one rule: picture seen on the page or through the platform, and a firm date; never a listing."""
    return (
        F.col("image.level").isin(*ELIGIBLE_IMAGE) & F.col("date.level").isin(*ELIGIBLE_DATE)
        & F.col("date.when").isNotNull() & ~_listing(df)
    )


def order_key(pos: Column | None = None) -> Column:
    """Day, then evidence level, then time: a day-only date must not beat an exact time of that day."""
    return F.struct(
        F.col("date.when").isNull().alias("undated"), F.to_date("date.when").alias("day"),
        (-dates.level_rank(F.col("date.level"))).alias("neg_level"), F.col("date.when").alias("when"),
        (pos if pos is not None else F.col("pos")).alias("pos"),
    )


def origins(sightings: DataFrame) -> DataFrame:
    """Per investigation: ``first_seen`` and, when that is a changed version of the picture,
    ``first_exact``, the earliest eligible unchanged one."""
    row = F.struct(*sightings.columns)
    key = order_key()
    found = sightings.filter(eligible(sightings)).groupBy("inv_id").agg(
        F.min_by(row, key).alias("first_seen"),
        F.min_by(row, F.when(F.col("image.kind") == "exact", key)).alias("_exact"),
    )
    return found.select("inv_id", "first_seen", F.when(
        F.col("first_seen.image.kind") == "variant", F.col("_exact")
    ).alias("first_exact"))


def scenes(sightings: DataFrame) -> DataFrame:
    """Earliest eligible sighting per query frame (frames count from 1)."""
    return sightings.filter(eligible(sightings) & F.col("image.frame").isNotNull()).groupBy(
        "inv_id", (F.col("image.frame") + 1).alias("frame")
    ).agg(F.min_by(F.struct(*sightings.columns), order_key()).alias("first_seen"))


def timeline(sightings: DataFrame, ordered: bool = False) -> DataFrame:
    """Sightings that show the picture, with ``order_key`` and ``is_eligible``.

    ``ordered`` adds a global sort, which range-partitions on investigation and key together, so one
    large investigation is spread over many tasks.
    """
    shown = sightings.filter(F.col("image.level") != "none").withColumns({
        "order_key": order_key(), "is_eligible": eligible(sightings),
    })
    return shown.orderBy("inv_id", "order_key") if ordered else shown


def leads(sightings: DataFrame, limit: int | None = None) -> DataFrame:
    """Timeline rows that are not eligible, in timeline order; the first ``limit``, or all."""
    return top_rows(
        timeline(sightings).filter(~F.col("is_eligible")), ["inv_id"], [F.col("order_key")], limit, "lead_rank"
    )


def similar_rows(candidates: DataFrame, sightings: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """What the engines returned and nothing confirmed, with a picture to judge by eye."""
    known = candidates if "canonical" in candidates.columns else candidates.withColumn(
        "canonical", urls.canonical(F.col("url"))
    )
    state = sightings.groupBy("inv_id", "canonical").agg(
        F.max_by("image.level", "pos").alias("_level")
    )
    open_rows = known.filter(F.col("canonical").isNotNull()).join(state, ["inv_id", "canonical"], "left").filter(
        F.coalesce("_level", F.lit("none")) == "none"
    ).withColumn("thumbnail", F.coalesce(blank_to_null(F.col("thumb")), F.get("thumbs", F.lit(0))))
    rest = [c for c in open_rows.columns if c not in ("inv_id", "canonical")]
    first = open_rows.filter(F.col("thumbnail").isNotNull()).groupBy("inv_id", "canonical").agg(
        F.min_by(F.struct(*rest), "pos").alias("c")
    ).select("inv_id", "canonical", "c.*")
    verdict = F.col("thumb_verdict") if "thumb_verdict" in first.columns else F.lit(None).cast("string")
    hint = blank_to_null(date_hint(F.col("url"), F.col("engine_date"), as_of))
    rows = first.select(
        "inv_id", "canonical", "pos", F.col("url").alias("link"), "thumbnail", "image_url",
        F.coalesce(blank_to_null(F.col("title")), urls.domain_of(F.col("url"))).alias("title"),
        hint.alias("published_at"), urls.domain_of(F.col("url")).alias("domain"),
        urls.platform_of(F.col("url")).alias("platform"),
        F.coalesce("match", F.lit("similar")).alias("match_type"), F.col("engines").alias("providers"),
        F.col("_level").isNotNull().alias("checked"), verdict.alias("thumb_verdict"),
        urls.is_listing_canonical(F.col("canonical")).alias("is_listing"),
    ).withColumn("date_text", F.coalesce(F.substring("published_at", 1, 10), F.lit(NO_DATE)))
    order = [
        F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "page", 1)
        .when(F.col("match_type") == "similar", 2).when(F.col("match_type") == "text", 3).otherwise(9),
        F.when(F.col("thumb_verdict") == "match", 0).when(F.col("thumb_verdict") == "differs", 2).otherwise(1),
        F.coalesce("published_at", F.lit("9999")), F.col("pos"),
    ]
    return top_rows(rows, ["inv_id"], order, limit, "similar_rank")


def run_stats(sightings: DataFrame, candidates: DataFrame, similar: DataFrame) -> DataFrame:
    """Counts of an investigation's run."""
    seen = sightings.groupBy("inv_id").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("date.when").isNotNull() & (F.col("image.level") != "none")).alias("with_dates"),
        F.count_if(F.col("image.level").isin(*ELIGIBLE_IMAGE)).alias("visually_confirmed"),
        F.count_if(F.col("image.level") == "engine_claim").alias("engine_claims"),
        F.count_if(F.col("image.level") == "none").alias("visually_rejected"),
    )
    offered = distinct_count(candidates, ["inv_id"], "canonical", "candidates")
    alike = similar.groupBy("inv_id").agg(F.count(F.lit(1)).alias("similar"))
    zero = ["checked", "with_dates", "visually_confirmed", "engine_claims", "visually_rejected", "candidates", "similar"]
    return seen.join(offered, "inv_id", "full").join(alike, "inv_id", "left").fillna(0, zero)


def public_item(df: DataFrame) -> DataFrame:
    """The row a reader sees, built from a sighting."""
    when, bound = F.col("date.when"), F.col("date.upper_bound")
    verdict = None
    for level, name in VERDICTS.items():
        test = F.col("image.level") == level
        verdict = F.when(test, name) if verdict is None else verdict.when(test, name)
    day = F.date_format(when, "yyyy-MM-dd")
    domain = urls.domain_of(F.col("url"))
    return df.select(
        "inv_id", F.coalesce(blank_to_null(F.col("title")), domain).alias("title"), F.col("url").alias("link"),
        blank_to_null(F.coalesce("caption", F.lit(""))).alias("snippet"),
        F.coalesce(blank_to_null(F.col("image.matched_url")), F.get("thumbs", F.lit(0))).alias("thumbnail"),
        F.coalesce(
            day, F.concat(F.lit(AT_LEAST_SINCE), F.date_format(bound, "yyyy-MM-dd")), F.lit(NO_DATE)
        ).alias("date_text"),
        dates.to_iso(when).alias("published_at"), domain.alias("domain"),
        urls.platform_of(F.col("url")).alias("platform"),
        F.coalesce(blank_to_null(F.col("match")), F.lit("similar")).alias("match_type"),
        dates.level_confidence(F.col("date.level")).alias("confidence"),
        (bound.isNotNull() & when.isNull()).alias("is_upper_bound"), F.col("date.sources").alias("evidence"),
        F.col("image.level").alias("image_level"), F.col("date.level").alias("date_level"),
        F.struct(
            verdict.alias("verdict"), F.col("image.kind").alias("match_kind"),
            F.col("image.phash").alias("phash_distance"), F.col("image.matched_url").alias("matched_image_url"),
            F.col("image.note").alias("note"),
        ).alias("visual"),
        F.col("round").alias("origin_round"),
        F.when(F.col("image.frame").isNotNull(), F.array(F.col("image.frame") + 1))
        .otherwise(F.array().cast("array<int>")).alias("frames"),
        _listing(df).alias("is_listing"),
    )


def carry_titles(cards: DataFrame, timeline_items: DataFrame) -> DataFrame:
    """A translated title copied from the timeline twin with the same link when the card has none."""
    twins = timeline_items.filter(F.coalesce("title_ar", F.lit("")) != "").groupBy("inv_id", "link").agg(
        F.max_by("title_ar", "pos").alias("_twin")
    )
    joined = cards.join(twins, ["inv_id", "link"], "left")
    return joined.withColumn("title_ar", F.coalesce(blank_to_null(F.col("title_ar")), F.col("_twin"))).drop("_twin")


# -------------------------------------------------------------------------------------- earlier report

def timeline_v1(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dated rows ascending, then undated; and per investigation the first dated row with counts.
    ``items``: ``inv_id, pos, url, published_at, ...``."""
    dated = F.coalesce("published_at", F.lit("")) != ""
    key = F.struct((~dated).alias("undated"), F.when(dated, F.col("published_at")).alias("at"), F.col("pos"))
    summary = items.groupBy("inv_id").agg(
        F.min_by("url", F.when(dated, key)).alias("first_url"),
        F.min(F.when(dated, F.col("published_at"))).alias("first_published_at"),
        F.count(F.lit(1)).alias("checked"), F.count_if(dated).alias("with_dates"),
    )
    return items.withColumn("order_key", key), summary


# ----------------------------------------------------------------------------------------- facets

def facet_counts(items: DataFrame, link: str = "link") -> DataFrame:
    """Rows per platform label, labels that occur only."""
    return items.groupBy("inv_id", urls.platform_facet(F.col(link)).alias("facet")).agg(
        F.count(F.lit(1)).alias("n")
    )


def facet_page(items: DataFrame, facet: str | None, page: int = 1, size: int = FACET_PAGE, link: str = "link") -> DataFrame:
    """The first ``page * size`` rows of a facet per investigation, in order."""
    kept = items if facet is None else items.filter(urls.platform_facet(F.col(link)) == facet)
    order = F.col("order_key") if "order_key" in items.columns else F.col("pos")
    return top_rows(kept, ["inv_id"], [order], page * size, "shown_rank")


# -------------------------------------------------------------------------------------- benchmark rules

def bench_verdicts(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``cases``: ``id, expected, acceptable array<string>``; ``results``: ``id, origin_url``."""
    found = urls.canonical(F.col("origin_url"))
    accepted = F.exists(
        F.coalesce("acceptable", F.array().cast("array<string>")), lambda u: F.coalesce(urls.canonical(u) == F.col("_found"), F.lit(False))
    )
    return cases.join(results, "id").withColumn("_found", found).withColumn("verdict", (
        F.when(F.col("_found").isNull(), "fail")
        .when(F.col("_found") == urls.canonical(F.col("expected")), "pass")
        .when(accepted, "acceptable").otherwise("fail")
    )).drop("_found")


def bench_rank(verdict: Column) -> Column:
    out = None
    for name, rank in BENCH_RANKS.items():
        out = F.when(verdict == name, rank) if out is None else out.when(verdict == name, rank)
    return out.otherwise(0)


def bench_regressions(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases whose verdict is worse than the baseline's."""
    old = baseline.select("id", F.col("verdict").alias("baseline_verdict"))
    return results.join(old, "id").filter(bench_rank(F.col("verdict")) < bench_rank(F.col("baseline_verdict")))


def bench_credits(runs: DataFrame, briefs: DataFrame) -> DataFrame:
    """Credits a run reported, else the number of paid engine labels it used."""
    paid = briefs.filter(F.col("label").rlike(PAID_LABELS)).groupBy("inv_id").agg(F.count(F.lit(1)).alias("_paid"))
    return runs.join(paid, "inv_id", "left").withColumn(
        "credits", F.coalesce("credits", F.col("_paid"), F.lit(0))
    ).drop("_paid")
