"""Metered calls, budgets, limits and failure streaks (batch forms; live forms are in ``streaming``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.columns import let
from sightline.operators import scans

# --- Fixed values ----------------------------------------------------------------------------------
BUDGETS = (
    ("quick", "image", 45.0, 4, 24), ("quick", "video", 45.0, 4, 24),
    ("deep", "image", 150.0, 15, 90), ("deep", "video", 200.0, 22, 120),
)
PER_MINUTE, PAID_PER_MINUTE, PAID_PER_DAY = 200, 10, 200
FAILURES_TO_OPEN, OPEN_SECONDS = 5, 60
COOLDOWN_SECONDS, COOLDOWN_STATUSES = 90, (429, 503)
# ---------------------------------------------------------------------------------------------------


def _since(days: int, as_of: Column) -> Column:
    return F.col("created_at") >= as_of - F.make_interval(days=F.lit(days))


def provider_usage(calls: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Calls, errors, mean latency and last call per provider in the window, busiest first."""
    return calls.filter(_since(days, as_of)).groupBy("provider").agg(
        F.count("id").alias("calls"), F.count_if(~F.col("ok")).alias("errors"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"), F.max("created_at").alias("last_call"),
    ).orderBy(F.desc("calls"), "provider")


def daily_calls(calls: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return calls.filter(_since(days, as_of)).groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("id").alias("calls")
    ).orderBy("day")


def metered(calls: DataFrame) -> DataFrame:
    """Raw call outcomes as metering rows: ``provider, method, url, status_code, latency_s, error, created_at``."""
    return calls.select(
        F.expr("uuid()").alias("id") if "id" not in calls.columns else F.col("id"), "provider",
        F.coalesce("url", F.lit("")).alias("url"), "method", "status_code",
        F.coalesce((F.col("status_code") != 0) & (F.col("status_code") < 400), F.lit(False)).alias("ok"),
        F.round(F.col("latency_s") * 1000, 2).alias("latency_ms"),
        F.when(F.col("error") != "", F.col("error")).alias("error"), "created_at",
    )


def budget_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUDGETS, "mode string, kind string, seconds double, credits int, pages int")


# -------------------------------------------------------------------------------------------- budgets

def admit_unit_costs(charges: DataFrame, cap: Column) -> DataFrame:
    """Charges of one credit each: the first ``cap`` by position. A plain window bound by the cap."""
    w = Window.partitionBy("inv_id").orderBy("pos")
    first = charges.select("inv_id", "pos").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    return charges.join(first.select("inv_id", "pos", F.lit(True).alias("_ok")), ["inv_id", "pos"], "left").withColumn(
        "accepted", F.coalesce("_ok", F.lit(False))
    ).drop("_ok")


class _Charge(scans.Rule):
    """A charge is spent where it fits, a refund stops at zero."""
    reads = ["credits"]

    def after(self, spent, credits):
        if credits is None or spent + credits > self.cap:
            return spent
        return max(0, spent + credits)

    def pieces(self, credits):
        cap, credits = self.cap, credits or 0
        if credits < 0:
            return scans.Pieces.of(cap, [(0, False, 0), *([(-credits, True, credits)] if -credits <= cap else [])])
        if credits == 0 or credits > cap:
            return scans.Pieces.same(0, cap)
        return scans.Pieces.of(cap, [(0, True, credits), (cap - credits + 1, True, 0)])

    def bounds(self, low, high, credits):
        fits = self.cap - (credits or 0)
        if (credits or 0) <= 0 or high <= fits or low > fits:
            return self.after(low, credits), self.after(high, credits)
        return min(low + credits, fits + 1), self.cap


def admit(charges: DataFrame, cap: int, chunk: int | None = None, fan: int = scans.FAN) -> DataFrame:
    """Spend in order while the sum fits: a charge that does not fit costs nothing and later, smaller ones
    may still fit; a negative charge is a refund that stops at zero, a null one changes nothing. Adds ``accepted`` and
    ``spent``.

    ``charges``: ``inv_id, pos, credits``; positions may have gaps. ``chunk`` and ``fan``: about how many rows are summed up at
    a time, and how many sums are composed at a time; the result does not depend on them.
    """
    rest = [c for c in charges.columns if c not in ("inv_id", "pos", "credits")]
    rows = charges.select("inv_id", "pos", F.col("credits").cast("int").alias("credits"), *rest)
    walked = scans.replay(rows, "inv_id", "pos", _Charge(cap), chunk, fan)
    return walked.select(
        "inv_id", "pos", "credits", *rest,
        ((F.col("credits") <= 0) | (F.col("before") + F.col("credits") <= cap)).alias("accepted"), F.col("spent").cast("int").alias("spent"),
    )


def skip_reasons(admitted: DataFrame, cap: int) -> DataFrame:
    """Why a charge was refused, with what was left at that moment."""
    return admitted.filter(~F.col("accepted")).select(
        "inv_id", "pos", "step", F.lit("credits").alias("reason"),
        F.concat(F.col("step"), F.lit(" needs "), F.col("credits"), F.lit(", "), F.lit(cap) - F.col("spent"), F.lit(" left")).alias("note"),
    )


def allot_pages(rounds: Column, cap: Column) -> Column:
    """``array<struct<round, granted, not_fetched>>`` from ``array<struct<round, wanted, reserve>>``: each
    round takes what it wants out of what is left above its reserve. Rounds are few per investigation."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("spent"),
        F.array().cast("array<struct<round:bigint,granted:bigint,not_fetched:bigint>>").alias("out"),
    )

    def step(acc, r):
        left = cap - acc["spent"]
        asked = F.when(r["reserve"] > 0, F.least(r["wanted"], F.greatest(F.lit(0), left - r["reserve"]))).otherwise(r["wanted"])
        granted = F.greatest(F.lit(0), F.least(asked, left)).cast("bigint")
        return let(granted, lambda g: F.struct(
            (acc["spent"] + g).alias("spent"),
            F.concat(acc["out"], F.array(F.struct(
                r["round"].cast("bigint").alias("round"), g.alias("granted"), (r["wanted"] - g).cast("bigint").alias("not_fetched")
            ))).alias("out"),
        ))

    return F.aggregate(F.array_sort(rounds), start, step)["out"]


class _Round(scans.Rule):
    """A round takes what it wants out of what is left above its reserve."""
    reads = ["wanted", "reserve"]

    def after(self, spent, wanted, reserve):
        left = self.cap - spent
        asked = min(wanted or 0, max(0, left - reserve)) if (reserve or 0) > 0 else wanted or 0
        return spent + max(0, min(asked, left))

    def pieces(self, wanted, reserve):
        wanted, limit = wanted or 0, self.cap - max(0, reserve or 0)
        if wanted <= 0 or limit <= 0:
            return scans.Pieces.same(0, self.cap)
        grows = [(0, True, wanted)] if wanted <= limit else []
        # Up to the limit; a state beyond it stays.
        return scans.Pieces.of(self.cap, [*grows, (max(0, limit - wanted + 1), False, limit), *([(limit + 1, True, 0)] if limit < self.cap else [])])

    def bounds(self, low, high, wanted, reserve):
        return self.after(low, wanted, reserve), self.after(high, wanted, reserve)  # more spent before is more spent after


def allot_rounds(rounds: DataFrame, cap: int, chunk: int | None = None, fan: int = scans.FAN) -> DataFrame:
    """:func:`allot_pages` for any number of rounds. ``rounds``: ``inv_id, round, wanted, reserve``; returns ``inv_id, round,
    granted, not_fetched``."""
    rows = rounds.select("inv_id", "round", F.col("wanted").cast("bigint").alias("wanted"), F.col("reserve").cast("bigint").alias("reserve"))
    walked = scans.replay(rows, "inv_id", "round", _Round(cap), chunk, fan)
    granted = F.col("spent") - F.col("before")
    return walked.select("inv_id", F.col("round").cast("bigint").alias("round"), granted.alias("granted"), (F.col("wanted") - granted).alias("not_fetched"))


def budget_snapshot(charges: DataFrame, pages: DataFrame, budgets: DataFrame) -> DataFrame:
    """Credits and pages spent per investigation next to their caps. ``pages``: ``inv_id, granted``."""
    spent = charges.groupBy("inv_id").agg(F.sum(F.when(F.col("accepted"), F.col("credits")).otherwise(0)).alias("credits"),
                                          F.count_if(~F.col("accepted")).alias("skipped"))
    fetched = pages.groupBy("inv_id").agg(F.sum("granted").alias("pages"))
    caps = budgets.select("inv_id", F.col("credits").alias("credits_cap"), F.col("pages").alias("pages_cap"))
    return caps.join(spent, "inv_id", "left").join(fetched, "inv_id", "left").fillna(0, ["credits", "skipped", "pages"])


# ------------------------------------------------------------------------------------ limits and streaks

def rate_limit_breaches(requests: DataFrame, seconds: int, limit: int, key: str = "caller") -> DataFrame:
    """Fixed windows in which a caller went over the limit. ``caller`` is the user, else the address."""
    return requests.groupBy(key, F.window("created_at", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("requests")
    ).filter(F.col("requests") > limit).select(
        key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") - limit).alias("over")
    )


def caller_key(user_id: Column, address: Column) -> Column:
    return F.coalesce(F.concat(F.lit("user:"), user_id), address)


def is_failure(status_code: Column) -> Column:
    """A provider failure: no answer, or a server error. Not the same as a call that is not ``ok``."""
    return status_code.isNull() | (status_code >= 500)
