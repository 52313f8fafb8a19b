"""The live jobs run over the event table as a finite stream; the SQL is that of their batch twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import usage
from sightline.plans.readings import CALLS_SQL, calls
from sightline.plans.registry import SQL, query
from sightline.session import shared_folder
from sightline.streaming import live

TS = "yyyy-MM-dd HH:mm:ss"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a stream, mapped as in the batch reading."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp")
    return s.select(
        F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 8).alias("provider"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status_code"), ts.alias("created_at"),
        F.concat(F.lit("user:"), "user_id").alias("caller"),
    )


def _folder(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints."""
    return f"{shared_folder(spark)}/live-{os.urandom(8).hex()}"


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Drains the stream into files and reads them back; a complete-mode trigger replaces the result."""
    spark = df.sparkSession
    out = _folder(spark)

    def write(batch: DataFrame, trigger: int) -> None:
        target = f"{out}/rows" if mode == "complete" else f"{out}/rows/trigger={trigger}"
        batch.write.mode("overwrite").parquet(target)

    query_ = df.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query(f"""
WITH {CALLS_SQL}
SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, provider, count(*) AS calls, count(*) FILTER (NOT ok) AS errors,
  round(avg(latency_ms), 1) AS avg_latency_ms FROM calls GROUP BY ALL""")
def live_usage(spark, sf):
    u = _run(live.live_usage(_event_stream(spark, sf), "1 day"), "complete")
    return u.select(F.date_format("window_start", TS).alias("window_start"), "provider", "calls", "errors", "avg_latency_ms")


def live_rate_limit(spark, sf):
    b = _run(live.live_limits(_event_stream(spark, sf), 86400, 5), "complete")
    return b.withColumn("window_start", F.date_format("window_start", TS))


def live_cooldown(spark, sf):
    s = _event_stream(spark, sf).select("provider", "id", F.col("created_at").alias("at"), "status_code")
    return live.cooldown_state(_run(live.live_cooldown(s))).select("id", "suppressed")


@query(f"""
WITH {CALLS_SQL}, n AS (SELECT user_id % 8 AS k, max(event_id) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT id, a AS answer_id FROM calls LEFT JOIN n ON user_id % 8 = k""")
def live_cache(spark, sf):
    """Every call asks for its provider's newest stored answer; half of the events are stored ones."""
    stored = calls(spark, sf).filter(F.col("id") % 2 == 0).select(
        F.lit("direct").alias("search_type"), F.col("provider").alias("image_hash"), "id", F.col("id").alias("created_at"),
        F.lit("deep").alias("mode"), F.lit(True).alias("has_payload"))
    asked = _event_stream(spark, sf).select(F.lit("direct").alias("search_type"), F.col("provider").alias("image_hash"),
                                            F.col("id").alias("request"), F.lit("deep").alias("mode"), F.lit(False).alias("force"))
    return _run(live.answer_from_cache(asked, stored)).select(F.col("request").alias("id"), "answer_id")


@query("SELECT DISTINCT 'u' || user_id AS media_hash FROM events")
def live_signature_ingest(spark, sf):
    """Each caller's first event becomes the indexed signature."""
    out = _folder(spark)
    s = _event_stream(spark, sf).select(
        F.regexp_replace("caller", "user:", "u").alias("media_hash"), F.col("id").alias("phash"), F.col("id").alias("dhash"),
        F.lit(None).cast("array<double>").alias("embedding"), F.lit("query").alias("source"), F.lit(None).cast("string").alias("ref_url"),
        F.col("created_at").alias("seen_at"))
    q = live.ingest_signatures(s, f"{out}/index", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{out}/index").parquet(f"{out}/index").select("media_hash")


for _name, _fn, _twin in (
    ("live_rate_limit", live_rate_limit, "rate_limit_day"), ("live_cooldown", live_cooldown, "cooldown_audit"),
):
    query(SQL[_twin], _name)(_fn)


