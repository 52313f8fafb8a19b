"""Reading and writing tables, image folders and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.schemas import IN_FLIGHT, TABLES


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A declared table; the schema is given, never inferred."""
    ddl = TABLES.get(name) or IN_FLIGHT[name]
    return spark.read.format(fmt).schema(ddl).options(**options).load(path)


def load_jdbc(spark: SparkSession, name: str, url: str, partition_column: str, lower, upper, parts: int, **options) -> DataFrame:
    """A declared table from a database, read in ``parts`` ranges of one column."""
    columns = [c.strip().split(" ")[0] for c in TABLES[name].split(",")]
    return spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=parts, **options,
    ).load().select(*columns)


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", by: list[str] | None = None) -> None:
    """Writes a table; ``by`` lays it out in folders (a date, a type) that later reads prune."""
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Decoded pictures; files that are not readable pictures are dropped."""
    reader = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Raw files (``path, modificationTime, length, content``) with their content hash."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.withColumn("media_hash", F.sha2("content", 256))


def undecodable(files: DataFrame, images: DataFrame) -> DataFrame:
    """Uploads to reject: files that no picture came from."""
    def same_form(path):
        return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")

    decoded = images.select(same_form(F.col("image.origin")).alias("_path"))
    return files.withColumn("_path", same_form(F.col("path"))).join(decoded, "_path", "left_anti").drop("_path")
