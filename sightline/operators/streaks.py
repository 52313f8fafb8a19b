"""Failure streaks and cooldowns over landed calls.

Order inside a provider matters, but a provider may own a third of all calls, so nothing runs over a
whole provider: calls are cut into time chunks, streaks are found inside chunks and only the ones that
touch a chunk's edge are stitched across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.usage import COOLDOWN_SECONDS, COOLDOWN_STATUSES, FAILURES_TO_OPEN

CHUNK_SECONDS = 3600


def _chunk_of(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(seconds * 1_000_000))


def _islands(calls: DataFrame, key: str, chunk_seconds: int) -> DataFrame:
    """Calls with their island number inside ``(key, chunk)``: a success opens one, failures join it."""
    c = calls.withColumn("chunk", _chunk_of(F.col("at"), chunk_seconds))
    chunk = Window.partitionBy(key, "chunk")
    return c.withColumn(
        "island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(chunk.orderBy("at", "id"))
    ).withColumn("last_island", F.max("island").over(chunk))


def runs(calls: DataFrame, key: str = "provider", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Every maximal run of consecutive failures: ``key, started_at, first_id, ended_at, length``.

    ``calls``: key, ``id, at, failed``; order is ``(at, id)``.
    """
    c = _islands(calls, key, chunk_seconds)
    # Windows and grouping share one shuffle on (key, chunk).
    local = c.groupBy(key, "chunk", "island", "last_island").agg(
        F.count_if("failed").alias("length"), F.min(F.when(F.col("failed"), F.struct("at", "id"))).alias("first"),
        F.max(F.when(F.col("failed"), F.col("at"))).alias("last_at"), F.bool_or(~F.col("failed")).alias("after_success"),
    )
    # Island 0 opens its chunk, the last island closes it; only those can continue elsewhere. Both are
    # kept even when they hold no failure, because an empty one is what ends a run at the edge.
    at_edge = (~F.col("after_success")) | (F.col("island") == F.col("last_island"))
    inner = local.filter(~at_edge & (F.col("length") > 0))
    # At most two rows per chunk reach this window, however many calls a provider made.
    w = Window.partitionBy(key).orderBy("chunk", "island")
    group = F.sum(F.col("after_success").cast("int")).over(w)
    stitched = local.filter(at_edge | ((F.col("island") == 0))).withColumn("g", group).groupBy(key, "g").agg(
        F.sum("length").alias("length"), F.min("first").alias("first"), F.max("last_at").alias("last_at"),
    ).filter(F.col("length") > 0)
    columns = [key, F.col("first.at").alias("started_at"), F.col("first.id").alias("first_id"),
               F.col("last_at").alias("ended_at"), "length"]
    return inner.select(*columns).unionByName(stitched.select(*columns))


def failure_streaks(
    calls: DataFrame, threshold: int = FAILURES_TO_OPEN, key: str = "provider", chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Runs of at least ``threshold`` consecutive failures."""
    return runs(calls, key, chunk_seconds).filter(F.col("length") >= threshold)


def cooldown_audit(lookups: DataFrame, seconds: int = COOLDOWN_SECONDS, key: str = "provider") -> DataFrame:
    """Adds ``suppressed``: a refusal (429 or 503) happened less than ``seconds`` before this lookup.

    Time is cut into buckets of the cooldown length; a refusal is copied to its own and the next bucket,
    so a window never spans more than two buckets.
    """
    bucket = _chunk_of(F.col("at"), seconds)
    refused = lookups.filter(F.col("status_code").isin(*COOLDOWN_STATUSES)).select(
        key, "at", F.explode(F.array(bucket, bucket + 1)).alias("bucket"), F.lit(True).alias("mark"))
    asked = lookups.withColumns({"bucket": bucket, "mark": F.lit(False)})
    both = asked.unionByName(refused, allowMissingColumns=True)
    w = Window.partitionBy(key, "bucket").orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("mark"), F.col("at")), ignorenulls=True).over(w)
    late = F.unix_micros("at") - F.unix_micros("last_refusal")
    return both.withColumn("last_refusal", last).filter(~F.col("mark")).withColumn(
        "suppressed", F.coalesce(late < seconds * 1_000_000, F.lit(False))
    ).drop("bucket", "mark", "last_refusal")
