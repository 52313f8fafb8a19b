"""Does a page show the picture? Verdicts from comparison tables.

A comparison is one readable image of one page against the query: ``inv_id, page, pos, image_url,
distance, similarity, same_scene, inliers`` and where it came from. Windows stay
within one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.skew import top_rows

# --- Fixed values ----------------------------------------------------------------------------------
SAME_DISTANCE = 8
CONFIRM, AMBIGUOUS = 0.90, 0.75
GEOMETRY_SIMILARITY, GEOMETRY_DISTANCE = 0.55, 26
# ---------------------------------------------------------------------------------------------------


def band_verdict(
    distance: Column, similarity: Column, geometry_no: Column, has_image: Column,
    confirm: float = CONFIRM, ambiguous: float = AMBIGUOUS, same: int = SAME_DISTANCE,
) -> Column:
    """``struct<verdict, match_kind>`` from the best hash distance and the best similarity of a page."""
    no = F.coalesce(geometry_no, F.lit(False))
    verdict = (
        F.when(~has_image, "no_image").when(distance <= same, "confirmed")
        .when(similarity.isNull(), "unverified")
        .when(similarity >= confirm, F.when(no, "ambiguous").otherwise("confirmed"))
        .when(similarity >= ambiguous, F.when(no, "rejected").otherwise("ambiguous"))
        .otherwise("rejected")
    )
    kind = F.when(~has_image, None).when(distance <= same, "exact").when((similarity >= confirm) & ~no, "variant")
    return F.struct(verdict.alias("verdict"), kind.alias("match_kind"))


def arbitrate(
    comparisons: DataFrame, confirm: float = CONFIRM, ambiguous: float = AMBIGUOUS,
    checks_after_claim: int | None = None,
) -> DataFrame:
    """Page verdicts where engine thumbnails only claim and the page's own images decide.

    An engine image that matches is a claim; a page image that matches confirms. With
    ``checks_after_claim``, page images past so many no longer count after a claim. A claim contradicted by geometry on every page image seen becomes
    ambiguous. Without a claim the similarity bands decide.

    Input: ``inv_id, page, pos, image_url, from_engine, distance, similarity, same_scene, inliers``.
    """
    keys = ["inv_id", "page"]
    page = Window.partitionBy(*keys)
    so_far = page.orderBy("pos")
    exact = F.coalesce(F.col("distance") <= SAME_DISTANCE, F.lit(False))
    worth = F.coalesce(
        (F.col("similarity") >= GEOMETRY_SIMILARITY)
        | (F.col("similarity").isNull() & (F.col("distance") <= GEOMETRY_DISTANCE)), F.lit(False)
    )
    scene = F.coalesce(F.col("same_scene"), F.lit(False))
    own = ~F.col("from_engine")
    c = comparisons.withColumns({
        "_claims": F.col("from_engine") & (exact | (worth & scene)),
        "_own_no": F.sum(own.cast("int")).over(so_far),
    })
    c = c.withColumn("_claim_pos", F.min(F.when(F.col("_claims"), F.col("pos"))).over(page))
    claimed = F.coalesce(F.col("_claim_pos") < F.col("pos"), F.lit(False))
    if checks_after_claim is not None:
        c = c.withColumn("_stop", F.min(F.when(claimed & own & (F.col("_own_no") > checks_after_claim), F.col("pos"))).over(page)).filter(
            F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    judged = own & claimed | worth
    c = c.withColumns({
        "_confirms": own & (exact | (judged & scene)),
        "_contradicts": own & ~exact & judged & (F.col("same_scene") == F.lit(False)),
        "_graded": ~exact & judged & F.col("inliers").isNotNull(),
        "_kind": F.when(exact, "exact").otherwise("variant"),
    })
    shown = F.struct("pos", F.col("_kind").alias("kind"), "image_url", "distance", "similarity")
    g = c.groupBy(*keys).agg(
        F.min(F.when(F.col("_confirms"), shown)).alias("hit"),
        F.min(F.when(F.col("_claims"), shown)).alias("claim"),
        F.count_if(own).alias("own_checked"), F.count_if(F.col("_contradicts")).alias("contradicted"),
        F.count(F.lit(1)).alias("checked"), F.min("distance").alias("best_distance"),
        F.max(F.when(~exact, F.col("similarity"))).alias("best_similarity"),
        F.max_by("image_url", F.when(~exact, F.struct("similarity", -F.col("pos")))).alias("best_url"),
        F.max_by("same_scene", F.when(F.col("_graded"), F.struct("inliers", -F.col("pos")))).alias("best_scene"),
    )
    band = band_verdict(
        F.lit(None).cast("int"), F.col("best_similarity"), F.col("best_scene") == F.lit(False), F.lit(True), confirm, ambiguous
    )
    beaten = (F.col("own_checked") > 0) & (F.col("contradicted") == F.col("own_checked"))
    return g.select(
        *keys,
        F.when(F.col("hit").isNotNull(), "confirmed")
        .when(F.col("claim").isNotNull(), F.when(beaten, "ambiguous").otherwise("confirmed"))
        .otherwise(band["verdict"]).alias("verdict"),
        F.when(F.col("hit").isNotNull(), F.col("hit.kind"))
        .when(F.col("claim").isNotNull(), F.when(~beaten, F.col("claim.kind")))
        .otherwise(band["match_kind"]).alias("match_kind"),
        F.when(F.col("hit").isNotNull(), "page").when(F.col("claim").isNotNull(), "engine").alias("matched_from"),
        F.coalesce("hit.image_url", "claim.image_url", "best_url").alias("matched_image_url"),
        F.coalesce("hit.distance", "claim.distance", "best_distance").alias("phash_distance"),
        F.round(F.coalesce("hit.similarity", "claim.similarity", F.when(
            F.col("hit").isNull() & F.col("claim").isNull(), F.col("best_similarity"))), 4).alias("similarity"),
    )


def page_image_evidence(comparisons: DataFrame, most: int | None = None) -> DataFrame:
    """Image evidence of each page: the platform's own media, then page images, then engine thumbnails.

    Thumbnails count only when no page image was judged different. Input: ``inv_id, page, level``
    (platform / page / engine_claim)``, pos`` (within the level, from 1)``, image_url, width, height,
    distance, same_scene, inliers, frame``. With ``most``, only so many images of a level are looked at.
    """
    keys = ["inv_id", "page"]
    rank = F.when(F.col("level") == "platform", 0).when(F.col("level") == "page", 1).otherwise(2)
    exact = F.coalesce(F.col("distance") <= SAME_DISTANCE, F.lit(False))
    matched = exact | F.coalesce(F.col("same_scene"), F.lit(False))
    c = (comparisons if most is None else comparisons.filter(F.col("pos") <= most)).withColumns({
        "_key": F.struct(rank.alias("rank"), F.col("pos")), "_matched": matched,
        "_differs": ~matched & (F.col("same_scene") == F.lit(False)) & (rank < 2),
    })
    page = Window.partitionBy(*keys)
    c = c.withColumn("_contra", F.bool_or(F.coalesce("_differs", F.lit(False))).over(page))
    c = c.filter(~((F.col("level") == "engine_claim") & F.col("_contra"))).withColumn(
        "_n", F.count(F.lit(1)).over(page.orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    hit = F.struct(
        "level", F.when(exact, "exact").otherwise("variant").alias("kind"), F.col("image_url").alias("matched_url"),
        "width", "height", F.col("distance").alias("phash"),
        F.when(exact, 0).otherwise(F.coalesce("inliers", F.lit(0))).alias("inliers"), F.col("_n").alias("checked"), "frame",
    )
    g = c.groupBy(*keys).agg(
        F.min_by(hit, F.when(F.col("_matched"), F.col("_key"))).alias("h"), F.max("_n").alias("n"),
        F.bool_or("_contra").alias("contra"), F.count_if(F.col("level") == "page").alias("page_images"),
    )
    note = (
        F.when(F.col("contra"), "page images differ")
        .when(F.col("h.level") == "engine_claim", F.when(F.col("page_images") == 0, "page not checkable").otherwise("page images not judged"))
    )
    return g.select(*keys, F.struct(
        F.coalesce("h.level", F.lit("none")).alias("level"), F.col("h.kind").alias("kind"),
        F.col("h.matched_url").alias("matched_url"), F.coalesce("h.width", F.lit(0)).alias("width"),
        F.coalesce("h.height", F.lit(0)).alias("height"), F.col("h.phash").alias("phash"),
        F.coalesce("h.inliers", F.lit(0)).alias("inliers"), F.coalesce("h.checked", "n").cast("int").alias("checked"),
        note.alias("note"), F.col("h.frame").alias("frame"),
    ).alias("image"))


def post_filter(items: DataFrame, verdicts: DataFrame, pages: int | None = None) -> DataFrame:
    """Items carry a verdict and drop when rejected; with ``pages``, those past the first so many of an investigation pass.

    ``items``: ``inv_id, pos, url, ...``; ``verdicts``: ``inv_id, url, verdict``.
    """
    first = top_rows(items.select("inv_id", "pos", "url"), ["inv_id"], [F.col("pos")], pages).drop("_rn")
    judged = first.join(verdicts.select("inv_id", "url", "verdict"), ["inv_id", "url"], "left").select(
        "inv_id", "pos", F.coalesce("verdict", F.lit("error")).alias("verdict")
    )
    return items.join(judged, ["inv_id", "pos"], "left").filter(
        F.col("verdict").isNull() | (F.col("verdict") != "rejected")
    )


def post_filter_summary(items: DataFrame, verdicts: DataFrame, pages: int | None = None) -> DataFrame:
    first = top_rows(items.select("inv_id", "pos", "url"), ["inv_id"], [F.col("pos")], pages)
    j = first.join(verdicts.select("inv_id", "url", "verdict"), ["inv_id", "url"], "left")
    return j.groupBy("inv_id").agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("rejected", "confirmed", "ambiguous")],
    )
