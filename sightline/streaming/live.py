"""Live forms of the metering, limiting and ingest jobs. Each has a batch twin over the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.detection import newest_answers, serve
from sightline.operators.usage import (
    COOLDOWN_SECONDS, COOLDOWN_STATUSES, FAILURES_TO_OPEN, OPEN_SECONDS, PAID_PER_DAY, PAID_PER_MINUTE, PER_MINUTE,
)
from sightline.sources.sinks import new_signatures

LATENESS = "10 minutes"
CHUNK_BUCKETS = 40    # an hour of cooldowns of 90 seconds


# ------------------------------------------------------------------------------------------- usage

def live_usage(calls: DataFrame, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Calls, errors, mean latency and last call per provider and window, as they arrive."""
    return calls.withWatermark("created_at", lateness).groupBy(
        F.window("created_at", window).alias("w"), "provider"
    ).agg(
        F.count("id").alias("calls"), F.count_if(~F.col("ok")).alias("errors"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"), F.max("created_at").alias("last_call"),
    ).select(F.col("w.start").alias("window_start"), "provider", "calls", "errors", "avg_latency_ms", "last_call")


def live_limits(requests: DataFrame, seconds: int = 60, limit: int = PER_MINUTE, lateness: str = LATENESS) -> DataFrame:
    """Callers over the limit of a fixed window."""
    return requests.withWatermark("created_at", lateness).groupBy(
        "caller", F.window("created_at", f"{seconds} seconds").alias("w")
    ).agg(F.count(F.lit(1)).alias("requests")).filter(F.col("requests") > limit).select(
        "caller", F.col("w.start").alias("window_start"), "requests", (F.col("requests") - limit).alias("over"))


def live_paid_limits(requests: DataFrame, lateness: str = LATENESS) -> tuple[DataFrame, DataFrame]:
    """The two limits of routes that spend money: per minute and per day."""
    return (
        live_limits(requests, 60, PAID_PER_MINUTE, lateness), live_limits(requests, 86400, PAID_PER_DAY, lateness)
    )


# ------------------------------------------------------------------------------------------ cooldown

def live_cooldown(lookups: DataFrame, seconds: int = COOLDOWN_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Lookups made while a refusal's cooldown was still running. ``lookups``: ``provider, id, at, status_code``.

    Every lookup is reported at once as not suppressed, and once more as suppressed as soon as a refusal less than
    ``seconds`` before it is known, whichever of the two arrives first: the last row of a lookup holds (see
    :func:`cooldown_state`). Lookups and refusals that are later than ``lateness`` no longer change a report.

    Time is cut into buckets of the cooldown length, so that of all refusals a lookup asks for two: the first of its own
    bucket and the last of the bucket before. State is one row for a provider and ``CHUNK_BUCKETS`` buckets: these two
    times of each bucket, and the lookups not suppressed yet as plain arrays. A refusal in a chunk's last bucket goes to
    the next chunk too.
    """
    asked = lookups.select("provider", "id", "at", "status_code")
    span, chunk_span = seconds * 1_000_000, seconds * 1_000_000 * CHUNK_BUCKETS
    refused = F.coalesce(F.col("status_code").isin(*COOLDOWN_STATUSES), F.lit(False))
    own, next_ = (F.floor((F.col("us") + ahead) / chunk_span).cast("bigint") for ahead in (0, span))
    timed = asked.filter(F.col("provider").isNotNull() & F.col("at").isNotNull()).withWatermark("at", lateness)
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    # Integers with nulls would become floats in pandas, so nulls are told apart: 1 no id, 2 no status.
    sent = timed.select(
        "provider", "at", F.unix_micros("at").alias("us"), refused.alias("refused"),
        *[F.coalesce(c, F.lit("0").try_cast(kinds[c])).alias(c) for c in ("id", "status_code")],
        (F.isnull("id").cast("int") + 2 * F.isnull("status_code").cast("int")).cast("tinyint").alias("missing"),
    ).withColumn("chunk", F.explode(F.when(F.col("refused"), F.array_distinct(F.array(own, next_))).otherwise(F.array(own))))
    kept = ["id", "us", "status_code", "missing"]

    def judge(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        chunk = int(key[1])
        before = chunk * CHUNK_BUCKETS - 1    # place 0: the last bucket of the chunk before
        first, last = (np.full(CHUNK_BUCKETS + 1, x, np.int64) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
        held = None
        if state.exists:
            first, last = (np.array(x, np.int64) for x in state.get[:2])
            if len(state.get[2]):
                held = pd.DataFrame(dict(zip(kept, state.get[2:])))
        for rows in batches:
            at, no = rows["us"].to_numpy(), rows["refused"].to_numpy()
            place = at // span - before
            np.minimum.at(first, place[no], at[no])
            np.maximum.at(last, place[no], at[no])
            own_rows = rows.loc[place > 0, kept]
            held = own_rows if held is None else pd.concat([held, own_rows], ignore_index=True)
            us = held["us"].to_numpy()
            place = us // span - before
            hit = (first[place] < us) | (last[place - 1] > us - span)
            if hit.any():
                yield held[hit].assign(provider=key[0])[["provider", *kept]]
                held = held[~hit]
        state.update((first.tolist(), last.tolist(), *(held[c].tolist() for c in kept)))
        # No row that is still in time belongs to the chunk once the watermark is at its end.
        state.setTimeoutTimestamp((chunk + 1) * chunk_span // 1000 + 1)

    types = {"id": kinds["id"], "us": "bigint", "status_code": kinds["status_code"], "missing": "tinyint"}
    hit = sent.groupBy("provider", "chunk").applyInPandasWithState(
        judge, f"provider {kinds['provider']}, " + ", ".join(f"{c} {types[c]}" for c in kept),
        "first array<bigint>, last array<bigint>, " + ", ".join(f"{c} array<{types[c]}>" for c in kept), "append", "EventTimeTimeout")
    once = hit.select(
        "provider", F.when(F.col("missing") % 2 == 0, F.col("id")).alias("id"), F.timestamp_micros("us").alias("at"),
        F.when(F.col("missing") < 2, F.col("status_code")).alias("status_code"))
    return asked.withColumn("suppressed", F.lit(False)).unionByName(once.withColumn("suppressed", F.lit(True)))


def cooldown_state(reports: DataFrame) -> DataFrame:
    """One row per lookup of what :func:`live_cooldown` has reported so far."""
    return reports.groupBy("provider", "id", "at", "status_code").agg(F.bool_or("suppressed").alias("suppressed"))


# -------------------------------------------------------------------------------------- ingest, cache

def ingest_signatures(incoming: DataFrame, index_path: str, checkpoint: str, lateness: str = "1 hour"):
    """Streaming writer that indexes the first occurrence of each media hash.

    Repeats within the watermark drop in state; anything older is caught by the anti-join with the index
    itself. Each trigger writes its own folder, so a replayed trigger overwrites what it wrote.
    ``incoming``: signature rows with ``seen_at``.
    """
    once = incoming.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["media_hash"])

    def fresh(batch: DataFrame, known: DataFrame) -> DataFrame:
        return new_signatures(batch.withColumn("pos", F.unix_micros("seen_at")), known, F.col("seen_at"))

    def write(batch: DataFrame, trigger_id: int) -> None:
        index = batch.sparkSession.read.schema("media_hash string, trigger bigint").option("basePath", index_path).parquet(index_path)
        known = index.filter(F.col("trigger") != trigger_id).select("media_hash")
        fresh(batch, known).write.mode("overwrite").parquet(f"{index_path}/trigger={trigger_id}")

    # The index is there, empty, before the first trigger reads it.
    spark = incoming.sparkSession
    empty = fresh(spark.createDataFrame([], incoming.schema), spark.createDataFrame([], "media_hash string"))
    empty.write.mode("ignore").parquet(f"{index_path}/trigger=-1")
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def answer_from_cache(requests: DataFrame, answers: DataFrame, keys=("search_type", "image_hash")) -> DataFrame:
    """Stream-static join: each incoming request with the newest stored answer that may serve it."""
    return serve(requests.join(newest_answers(answers, list(keys)), list(keys), "left"))
