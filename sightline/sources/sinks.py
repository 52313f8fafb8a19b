"""Rows to store: searches with their results, signatures, detections. Functions shape rows; ``save`` writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import vectors
from sightline.functions.columns import blank_to_null

# --- Fixed values ----------------------------------------------------------------------------------
VECTOR_DIGITS = 6
# ---------------------------------------------------------------------------------------------------


def search_header(searches: DataFrame) -> DataFrame:
    """Header rows: the result count is that of the list as it came."""
    return searches.withColumn("result_count", F.coalesce(F.size("results"), F.lit(0))).drop("results")


def search_results(searches: DataFrame) -> DataFrame:
    """Numbered result rows. A row without url is not stored, but the numbers keep counting over it.

    ``searches``: ``id, results array<struct<url, title, snippet, thumbnail, domain, published_at, confidence>>``.
    """
    rows = searches.select(F.col("id").alias("search_id"), F.posexplode("results").alias("rank", "r"))
    return rows.filter(F.coalesce("r.url", F.lit("")) != "").select(
        "search_id", F.col("r.url").alias("url"),
        blank_to_null(F.coalesce("r.title", F.lit(""))).alias("title"),
        F.col("r.snippet").alias("snippet"), blank_to_null(F.col("r.thumbnail")).alias("thumbnail_url"),
        blank_to_null(F.col("r.domain")).alias("domain"), F.col("r.published_at").alias("published_at"),
        F.col("r.confidence").alias("confidence"), "rank",
    )


def new_signatures(incoming: DataFrame, index: DataFrame, at: Column, model: str | None = None) -> DataFrame:
    """Signature rows whose ``media_hash`` is not indexed yet, one per hash (the first of the batch).

    ``incoming``: ``media_hash, pos, phash, dhash, embedding, source, ref_url``. The anti-join reads only
    the hash column of the index.
    """
    rest = [c for c in incoming.columns if c != "media_hash"]
    first = incoming.filter(F.coalesce("media_hash", F.lit("")) != "").groupBy("media_hash").agg(
        F.min_by(F.struct(*rest), "pos").alias("r")
    ).select("media_hash", "r.*")
    fresh = first.join(index.select("media_hash"), "media_hash", "left_anti")
    return fresh.select(
        "media_hash", "phash", "dhash",
        vectors.rounded(F.col("embedding"), VECTOR_DIGITS).cast("array<float>").alias("embedding"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"),
        F.when(F.col("embedding").isNotNull(), F.lit(model)).alias("model"), "source",
        blank_to_null(F.coalesce("ref_url", F.lit(""))).alias("ref_url"),
        at.alias("created_at"),
    )
