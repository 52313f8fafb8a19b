"""Quality rules by host: failures shrunk by an empirical beta prior, and host verdicts joined back. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import join_back, settle

# ---------------------------------------------------------------------------------------- Fixed values
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOL_PATTERN = r"[#*$%&|<>]"
WINDOW_WORDS = 5
FEWEST_WORDS = 10
MOST_REPEATED = 20        # percent of the words
WORST_HOST = 0.5          # shrunk failure rate above which a whole host is rejected
# ---------------------------------------------------------------------------------------------------


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words that lie in windows of ``WINDOW_WORDS`` words found twice or more in the text, each word counted once.

    ``hashes``: of the window at each place. The places of equal windows meet by sorting (hash, place); equal hashes
    are held against the words themselves. Work n log n in the text's own row, and nearly all texts stop at the test
    whether any hash repeats."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        part = lambda x: F.slice(words, x["i"] + 1, WINDOW_WORDS)
        return F.when(a["h"] == b["h"], part(a) == part(b)).otherwise(False)

    def twins(s: Column) -> Column:
        last = F.size(s) - 1
        found = F.filter(s, lambda x, k: ((k > 0) & same(x, F.get(s, k - 1))) | ((k < last) & same(x, F.get(s, k + 1))))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        # Every window adds the words that the next one does not cover; the last adds all.
        return F.aggregate(
            F.transform(at, lambda i, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW_WORDS)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x,
        )

    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
        once(placed, lambda s: once(twins(s), covered))
    )


def measure(results: DataFrame, id: str = "id", domain: str = "domain", text: str = "snippet") -> DataFrame:
    """``id, domain, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of each result's whole
    text. A null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = results.select(F.col(id).alias("id"), F.col(domain).alias("domain"), t.alias("t"))
    rows = rows.select("id", "domain", "t", F.filter(F.split("t", GAP_PATTERN), lambda w: w != "").alias("words"))
    n = F.size("words")
    windows = F.when(n >= WINDOW_WORDS, F.transform(F.sequence(F.lit(1), n - WINDOW_WORDS + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW_WORDS)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_PATTERN))
    rows = rows.select(
        "id", "domain", "words", windows.alias("windows"), lines.alias("lines"), n.cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", GAP_PATTERN, "")).cast("bigint").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", SYMBOL_PATTERN, ""))).cast("bigint").alias("n_symbols"),
    )
    rows = rows.select(
        "id", "domain", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("windows")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_rates(measured: DataFrame, worst: float = WORST_HOST) -> DataFrame:
    """``domain, n_results, n_failed, rate, host_rejected``: each domain's failure rate shrunk by a beta prior.

    The prior is fitted to the domains themselves by moments: the mean of their rates weighted by results, and the
    variance between domains that is left when the binomial one is taken away. Four sums come to the driver."""
    hosts = settle(measured.groupBy("domain").agg(F.count(F.lit(1)).alias("n_results"), F.count_if("base_failed").alias("n_failed")))
    p = F.col("n_failed") / F.col("n_results")
    rows, failed, hosts_n, spread = hosts.agg(F.sum("n_results"), F.sum("n_failed"), F.count(F.lit(1)), F.sum(p * p * F.col("n_results"))).first()
    mean = (failed or 0) / rows if rows else 0.0
    within = mean * (1 - mean) * (hosts_n - 1)
    between = max(0.0, (spread or 0.0) - (rows or 0) * mean * mean - within) / max(1.0, (rows or 0) * (1 - 1 / max(1, hosts_n)))
    # Weight of the prior in results: large where domains hardly differ, at least 2 (as the uniform prior has).
    weight = min(1e6, max(2.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6 if hosts_n > 1 else 2.0
    rate = (F.col("n_failed") + mean * weight) / (F.col("n_results") + weight)
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > worst)


def judge_results(results: DataFrame, id: str = "id", domain: str = "domain", text: str = "snippet", worst: float = WORST_HOST) -> DataFrame:
    """Rules on search results' texts, with the verdict of their host.

    ``results``: ``id, domain, snippet``; other columns are not read. Returns one row per row: ``id, domain, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rate``. A result is kept if it does not fail
    itself and its domain's shrunk failure rate is at most ``worst``.

    A null or empty text has no words and fails. A null domain is a domain of its own. Rows that repeat count each. An
    empty table gives an empty result. Measures are made once and settled without the texts; a domain with a third of
    all rows is combined before its shuffle, and its verdict is dealt out over salts."""
    measured = settle(measure(results, id, domain, text))
    hosts = host_rates(measured, worst).select("domain", "rate", "host_rejected")
    out = join_back(measured, hosts, ["domain"], "id")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host_rejected")
