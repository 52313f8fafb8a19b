"""Mixing domains to target weights: a temperature found by bisection, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import join_back, settle

# ---------------------------------------------------------------------------------------- Fixed values
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 1_000_000
MOST_REPETITION = 4.0
DIGITS = 6                # decimals of the exponent
BUCKET_DIGITS = 3         # hex digits of the permutation key by which running sums are cut: 4,096 pieces an epoch
# ---------------------------------------------------------------------------------------------------


def word_count(text):
    """Tokens of a text as a mixture counts them: its words. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def bisect(too_far, low: float = 0.0, high: float = 1.0, steps: int = 40) -> float:
    """The largest exponent between ``low`` and ``high``, to ``DIGITS`` decimals, that is not ``too_far``."""
    if not too_far(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if too_far(middle) else (middle, high)
    return math.floor(low * 10**DIGITS) / 10**DIGITS


def domain_shares(results: DataFrame) -> DataFrame:
    """``domain, total, share`` of the tokens; domains without tokens have no share. Settled: one row per domain."""
    totals = settle(results.groupBy("domain").agg(F.sum("n_tokens").alias("total")).filter("total > 0"))
    whole = totals.agg(F.sum("total")).first()[0] or 1
    return totals.withColumn("share", F.col("total") / F.lit(float(whole)))


def find_exponent(shares: DataFrame, most_repetition: float | None = None, least_entropy: float | None = None, evenness: float | None = None) -> float:
    """The exponent a of weights share^a: 1 is the natural mixture, 0 reads all domains alike. One of three targets:

    ``most_repetition``: the flattest mixture in which no domain is read more than so many times as often as the largest
    one; it needs the extreme shares alone. ``least_entropy`` (in nats): the mixture closest to the natural one whose
    entropy is no less; 0 where none has it. ``evenness``: the same, for the entropy that lies so far on the way
    (0 to 1) from the natural mixture's to that of equal weights. Each step of the bisection for an entropy is one
    aggregation over the domains, of which two numbers come back."""
    if sum(t is not None for t in (most_repetition, least_entropy, evenness)) != 1:
        raise ValueError("one target: most_repetition, least_entropy or evenness")
    if most_repetition is not None:
        low, high = shares.agg(F.min("share"), F.max("share")).first()
        if not low or most_repetition < 1:
            return 1.0
        # Repetition of the rarest domain while the largest is read once: (high / low)^(1 - a).
        return round(1.0 - bisect(lambda flat: (high / low) ** flat > most_repetition), DIGITS)

    def entropy(a: float) -> float:
        z, s = shares.agg(F.sum(F.pow("share", F.lit(a))), F.sum(F.pow("share", F.lit(a)) * F.log("share"))).first()
        return math.log(z) - a * s / z if z else 0.0

    if evenness is not None:
        natural, n = entropy(1.0), shares.count()
        least_entropy = natural + evenness * (math.log(n) - natural) if n else 0.0
    return bisect(lambda a: entropy(a) < least_entropy, steps=24)


def mixture(
    results: DataFrame, most_repetition: float | None = MOST_REPETITION, least_entropy: float | None = None, evenness: float | None = None, budget: int | None = None,
) -> DataFrame:
    """``domain, total, weight, quota, epochs``: the tokens that each domain gives to the mixture.

    ``results``: ``domain, n_tokens``. ``budget``: tokens of the whole mixture; without one, the least that reads every
    text once."""
    shares = domain_shares(results)
    a = find_exponent(shares, most_repetition, least_entropy, evenness)
    powered = shares.withColumn("p", F.pow("share", F.lit(a)))
    z, most = powered.agg(F.sum("p"), F.max(F.col("total") / F.col("p"))).first()
    whole = float(budget) if budget is not None else (most or 0.0) * (z or 1.0)
    quota = F.round(F.col("p") / F.lit(z or 1.0) * F.lit(whole)).cast("bigint")
    return powered.select("domain", "total", (F.col("p") / F.lit(z or 1.0)).alias("weight"), quota.alias("quota"), F.ceil(quota / F.col("total")).cast("int").alias("epochs"))


def permutation_key(epoch, id, seed: int):
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(id.cast("string"), F.lit(""))))


def mix_results(
    results: DataFrame, id: str = "id", domain: str = "domain", n_tokens: str = "n_tokens", most_repetition: float | None = MOST_REPETITION,
    least_entropy: float | None = None, evenness: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1,
) -> DataFrame:
    """Mixes search results by domain: which are read in which epoch and block.

    ``results``: ``id, domain, n_tokens``; other columns are not read. Returns one row per result and reading: ``id,
    domain, n_tokens, epoch, block, key``. Each epoch of a domain is a permutation of its results by a seeded hash;
    its results are read until the domain's quota of tokens is used up, so the quota is exceeded by less than one
    result. A block takes ``block_tokens`` times the domain's weight from each domain; within a block, ``key`` is the
    order. The natural use: write by ``block``, sort by ``key``.

    A null domain is a domain of its own. Null or negative tokens count as 0; a result without tokens is never read. Rows
    that repeat are read each; a null id has a fixed place. An empty table gives an empty result.

    The running sums that a quota needs are cut at the leading digits of the hash: sums of pieces first, then rows
    within a piece, so a domain with a third of all rows is thousands of groups."""
    rows = results.select(F.col(id).alias("id"), F.col(domain).alias("domain"), F.greatest(F.coalesce(F.col(n_tokens).cast("bigint"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    rows = settle(rows.filter("n_tokens > 0"))  # tokens are often counted in this very plan
    plan = settle(mixture(rows, most_repetition, least_entropy, evenness, budget))
    rows = join_back(rows, plan, ["domain"], "id", "inner")
    read = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).filter("quota > 0")
    read = read.withColumn("key", permutation_key(F.col("epoch"), F.col("id"), seed)).withColumn("piece", F.substring("key", 1, BUCKET_DIGITS))
    pieces = read.groupBy("domain", "epoch", "piece").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("domain", "epoch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("domain").alias("d"), F.col("epoch").alias("e"), F.col("piece").alias("p"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("domain", "epoch", "piece").orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("domain").eqNullSafe(F.col("d")) & (F.col("epoch") == F.col("e")) & (F.col("piece") == F.col("p"))
    begin = F.col("epoch") * F.col("total") + F.col("earlier") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    out = read.join(pieces, same).withColumn("begin", begin).filter("begin < quota")
    return out.select("id", "domain", "n_tokens", "epoch", F.floor(F.col("begin") / (F.col("weight") * F.lit(float(block_tokens)))).cast("bigint").alias("block"), "key")


def copies(results: DataFrame, mixed: DataFrame, id: str = "id", domain: str = "domain", text: str = "snippet", seed: int = 1) -> DataFrame:
    """``results``, each as often as ``mixed`` reads it, with all of its columns; rows that repeat an id go together.

    All epochs of a domain but the last are whole, and the last ends at one key: that key, one row per domain, is all
    that the texts are joined with."""
    ends = mixed.groupBy("domain").agg(F.max(F.struct("epoch", "key")).alias("end"))
    ends = settle(ends.select("domain", F.col("end.epoch").alias("last"), F.col("end.key").alias("end")))
    rows = results.select(F.col(id).alias("id"), F.col(domain).alias("domain"), word_count(F.col(text)).alias("words"), F.struct("*").alias("row"))
    rows = join_back(rows.filter("words > 0"), ends, ["domain"], "id", "inner")
    times = F.col("last") + (permutation_key(F.col("last"), F.col("id"), seed) <= F.col("end")).cast("int")
    return rows.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select("row.*")
