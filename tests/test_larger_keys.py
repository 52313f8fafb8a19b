"""Queries against their SQL on keys beyond those of the given tables."""

import os
import shutil
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def shifted(spark, folder, table, **columns):
    """The smallest tables, one of them with other keys; the folder's name ends in the table's."""
    target = str(folder)
    for name in os.listdir(SF):
        if name != f"{table}.parquet":
            shutil.copy(f"{SF}/{name}", f"{target}/{name}")
    df = spark.read.parquet(f"{SF}/{table}.parquet").withColumns(columns)
    df.toPandas().to_parquet(f"{target}/{table}.parquet", coerce_timestamps="us")
    return target


def test_levels_of_page_images_with_large_part_keys(spark, tmp_path):
    sf = shifted(spark, tmp_path, "lineitem", l_partkey=F.col("l_partkey") * 997 + F.col("l_orderkey") % 7 * 30000)
    ok, message, _ = compare.check(spark, compare.connect(sf), "page_image_evidence", sf)
    assert ok, message


def test_crawl_dates_of_all_rendered_pages(spark, tmp_path):
    sf = shifted(spark, tmp_path, "pages", page_id=F.col("page_id") + 1440)
    ok, message, _ = compare.check(spark, compare.connect(sf), "rendered_results", sf)
    assert ok, message


def test_signatures_beyond_the_range_of_shown_names(spark, tmp_path):
    sf = shifted(spark, tmp_path, "embeddings", vec_id=F.when(F.col("vec_id") % 4 < 2, F.col("vec_id")).otherwise(F.col("vec_id") + 998000))
    more = spark.read.parquet(f"{sf}/embeddings.parquet")
    (more.unionAll(more.withColumn("vec_id", F.col("vec_id") + 1100000))).toPandas().to_parquet(f"{sf}/embeddings.parquet")
    ok, message, _ = compare.check(spark, compare.connect(sf), "signature_insert", sf)
    assert ok, message


def test_tasks_of_heavy_rows_grow_in_number_not_in_length(spark, tmp_path):
    from sightline.operators import skew

    (tmp_path / "orders").mkdir()
    spark.range(410_000).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "orders"))
    parts = skew.widen(spark.read.parquet(str(tmp_path / "orders")), "id").rdd.glom().map(len).collect()
    assert sum(parts) == 410_000 and max(parts) < 25_000
