"""Joins and counts that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 500_000
ROWS_PER_TASK = 20_000    # about, of work that is heavy per row


def salted_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner",
    spread: Sequence[str] = (), rows_per_salt: int = ROWS_PER_SALT, few_hint: str | None = None,
) -> DataFrame:
    """Equi-join whose hot keys are split: ``many`` may repeat a key without bound, ``few`` holds few
    rows per key.

    Keys are counted with map-side combine; a key with more than ``rows_per_salt`` rows in ``many`` gets
    several salts, its rows are dealt out by a hash of ``spread`` and the matching ``few`` rows are
    repeated once per salt. Ordinary keys keep salt 0, so nothing else is copied. ``few_hint`` is a join hint for
    ``few``: sizes of tables whose rows were multiplied are underestimated.
    """
    keys = list(keys)
    spread = list(spread) or [c for c in many.columns if c not in keys] or keys
    hot = (
        many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_salt)
        .select(*keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts"))
    )
    # Whether the list of hot keys (at most rows / rows_per_salt) is broadcast is left to the optimizer's size check.
    left = many.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")
    ).drop("_salts")
    right = few.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return left.join(right.hint(few_hint) if few_hint else right, [*keys, "_salt"], how).drop("_salt")


def distinct_count(df: DataFrame, group: Sequence[str], value: str | Column, name: str) -> DataFrame:
    """Exact distinct count per group in two combining steps; a hot group is spread over its values."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        df.select(*group, value.alias("_v")).filter(F.col("_v").isNotNull()).distinct()
        .groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    )


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | None, name: str = "_rn") -> DataFrame:
    """The first ``k`` rows of each group with their rank; all of them without ``k``. ``row_number <= k`` is planned with a group limit below the
    shuffle, so a hot group sends at most ``k`` rows per task."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partitions into the session's full shuffle width. Adaptive execution sizes partitions by
    bytes; before a step that multiplies rows or work per byte, that would leave it to one task."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *columns)


def widen(df: DataFrame, *columns: str) -> DataFrame:
    """Spreads a narrow table before work that is heavy per row: over all cores, and with more rows over more tasks, so
    that none gets longer. Splits of a file follow its bytes, which for a narrow column of many rows are few."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)), *columns)
