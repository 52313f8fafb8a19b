"""Hash and vector arithmetic as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.columns import let


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_distance(phash_a: Column, dhash_a: Column, phash_b: Column, dhash_b: Column) -> Column:
    """The smaller of the two Hamming distances; null when a signature is incomplete."""
    p, d = hamming(phash_a, phash_b), hamming(dhash_a, dhash_b)
    return F.when(p.isNotNull() & d.isNotNull(), F.least(p, d))


def hash_to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hex_to_hash(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("bigint")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 when a norm is 0, null when a side is null."""
    length = norm(a) * norm(b)
    return F.when(a.isNotNull() & b.isNotNull(), let(
        length, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    ))


def l2_normalise(a: Column) -> Column:
    return let(norm(a), lambda n: F.when(n == 0, a.cast("array<double>")).otherwise(
        F.transform(a, lambda x: x.cast("double") / n)
    ))


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x.cast("double"), digits))
