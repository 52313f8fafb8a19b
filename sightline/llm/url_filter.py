"""URL rules carried over redirects: components of redirect and canonical links share block decisions. Native expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import components, join_back, settle

# ---------------------------------------------------------------------------------------- Fixed values
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ATTRIBUTE = r"""(?is)\b%s\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
# ---------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def page_key(url: Column) -> Column:
    """The address that aliases are compared by: without fragment, the part before the path lower-cased."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substring(bare, F.length(head) + 1, F.length(bare)))


def _value(tag: Column, name: str) -> Column:
    return F.btrim(F.regexp_extract(tag, ATTRIBUTE % name, 1), F.lit("\"'"))


def alias_links(pages: DataFrame) -> DataFrame:
    """``url, target``: canonical links and immediate refreshes that the ``html`` of ``pages`` declares; addresses
    without a scheme are read against the page's own."""
    tags = pages.filter("url is not null and html is not null").select("url", F.explode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("tag"))
    canonical = F.when(F.array_contains(F.split(F.lower(_value(F.col("tag"), "rel")), r"\s+"), "canonical"), _value(F.col("tag"), "href"))
    refresh = F.when(F.lower(_value(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_value(F.col("tag"), "content"), r"(?is)\burl\s*=\s*['\"]?([^'\"]*)", 1))
    found = tags.select("url", F.explode(F.array_compact(F.array(canonical, refresh))).alias("target"))
    found = found.select("url", F.trim(F.replace("target", F.lit("&amp;"), F.lit("&"))).alias("target")).filter("target <> ''")
    scheme, root = F.regexp_extract("url", r"(?s)^(.*?:)//", 1), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace("url", r"(?s)[?#].*$", ""), r"(?s)^(.*?://.*/)", 1)
    whole = F.when(F.col("target").contains("://"), F.col("target")).when(F.col("target").startswith("//"), F.concat(scheme, "target")).when(
        F.col("target").startswith("/"), F.concat(root, "target")).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), "target"))
    return found.select("url", whole.alias("target"))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, verdict`` of the longest rule that fits each url; urls that none fits are left out.

    A rule fits its host and all subdomains if the path starts with the rule's. Hosts are opened into their suffixes,
    which are joined with the rules by equality: any number of rules. An allow goes before a block of equal length."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("v"))
    fits = asked.join(r, "rule_host").filter(F.startswith("path", "rule_path"))
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(name).alias("n"), (F.col("v") == "allow").alias("allow"), name.alias("rule"), F.col("v").alias("verdict")))
    return fits.groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Allow or block the landed pages of investigations by address, aliases included.

    ``pages``: ``url`` and ``html`` (for canonical links and refreshes); other columns are not read. ``rules``: rows of
    ``verdict, host, path``. ``redirects``: known redirects, ``url, target``. Returns one row per different url: ``url,
    host, path, rule, verdict, component``.

    A url's own rule decides, the longest one that fits. A url without a rule is blocked if a blocked address, landed
    or only linked to, is in its component of redirects and canonical links, whichever way they point; else allowed. An
    explicit allow goes before what aliases hand on: it is never overturned, and it does not clear others.

    Null and malformed urls have an empty host and path, no rule, and are allowed; a null url is one row. Pages that
    repeat are one row. An empty table gives an empty result. ``component`` is null for a url without links."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    read = pages.select("url", "html")
    links = alias_links(read)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target").filter("url is not null and target is not null"))
    links = settle(links.select(page_key(F.col("url")).alias("a"), page_key(F.col("target")).alias("b")).filter("a <> b").distinct())
    urls = read.select("url").distinct()
    urls = settle(urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), page_key(F.col("url")).alias("node")))
    ruled = fitting_rules(urls.filter("url is not null"), rules)
    known = settle(urls.join(ruled, "url", "left"))
    groups = components(links)
    # Addresses that are only linked to are judged as well.
    named = groups.select(F.col("node").alias("url"), host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"), "component")
    blocked = named.join(fitting_rules(named, rules).filter("verdict = 'block'"), "url", "left_semi").select("component").distinct()
    handed = groups.join(blocked.withColumn("handed", F.lit("block")), "component", "left")
    out = join_back(known, handed, ["node"], "url")
    return out.select("url", "host", "path", "rule", F.coalesce("verdict", "handed", F.lit("allow")).alias("verdict"), "component")
