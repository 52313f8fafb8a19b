"""Shape of the plans that must hold at scale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.operators import candidates as C
from sightline.operators import catalog, skew, usage
from sightline.operators import evidence as E
from sightline.plans import report as R
from sightline.plans import workloads
from sightline.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


HEAVY = ["candidates_rank_cap", "hash_near_dup", "near_duplicates", "cosine_topk", "source_attribution", "similar_rows", "prescreen_verdicts", "cache_split"]


@pytest.mark.parametrize("name", HEAVY)
def test_no_pairwise_joins(spark, name):
    p = plan(workloads.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(str(n), "p", "u", "GET", 200, True, 1.0, None, dt.datetime(2024, 1, 1)) for n in range(3)]
    from sightline.schemas import TABLES

    tables.save(spark.createDataFrame(rows, TABLES["provider_calls"]), str(tmp_path / "calls"))
    calls = tables.load(spark, "provider_calls", str(tmp_path / "calls"))
    p = plan(usage.provider_usage(calls, F.lit("2024-01-31").cast("timestamp")))
    assert "GreaterThanOrEqual(created_at" in p and "url" not in p.split("ReadSchema")[1].split("\n")[0]
    files = spark.createDataFrame([("a", "u1", dt.datetime(2024, 1, 1))], "id string, user_id string, created_at timestamp")
    tables.save(files, str(tmp_path / "files"))
    p = plan(catalog.history_page(spark.read.parquet(str(tmp_path / "files")), "u1", 5, 5))
    assert "EqualTo(user_id,u1)" in p and "TakeOrderedAndProject" in p


def test_caps_are_limited_before_the_shuffle(spark):
    d = R.leads(workloads_sightings(spark), 20)
    assert plan(d).count("WindowGroupLimit") == 2
    assert "Python" not in plan(d)


def workloads_sightings(spark):
    from sightline.plans.readings import sightings

    return sightings(spark, "/root/testdata/sf0.001")


def test_page_dates_do_not_shuffle(spark):
    none = F.lit(None).cast("string")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        "url", "html", *[none.alias(c) for c in ("last_modified", "tweet_created_at", "crawl_date")])
    p = plan(E.date_pages(pages, F.lit("2024-01-01").cast("timestamp")))
    assert "Exchange" not in p and "Python" not in p


def test_salted_join_splits_hot_keys_and_keeps_all_rows(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k2", 3), ("gone", 4)], "k string, v int")
    got = skew.salted_join(many, few, ["k"], spread=["id"], rows_per_salt=100)
    assert got.filter("k = 'hot'").count() == 4000 and got.filter("k = 'k2'").count() == 1 and got.count() == 4001
    left = skew.salted_join(many, few, ["k"], "left", spread=["id"], rows_per_salt=100)
    assert left.count() == 4000 + 1000


def test_merge_is_whole_under_repetition(spark):
    n = 2000
    rows = spark.range(n).select(
        F.lit("i").alias("inv_id"), F.col("id").alias("pos"), F.lit("https://one.example/a").alias("url"), F.lit("").alias("title"),
        F.concat(F.lit("http://t/"), "id").alias("thumb"), F.lit(None).cast("string").alias("image_url"),
        F.concat(F.lit("e"), F.col("id") % 3).alias("engine"), F.lit(None).cast("int").alias("copy_id"), F.lit("page").alias("match"),
        *[F.lit(None).cast("string").alias(c) for c in ("crawl_date", "first_indexed", "engine_date")])
    (m,) = C.merge_candidates(rows).collect()
    assert m.engines == ["e0", "e1", "e2"] and len(m.thumbs) == n and m.copy_ids == []
    assert C.candidate_thumbs(C.with_canonical(rows)).count() == n
