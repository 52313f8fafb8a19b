"""Similarity joins over picture signatures, without comparing every pair."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import vectors
from sightline.operators.skew import salted_join, spread, top_rows
from sightline.operators.vector_index import SLACK, VectorIndex
from sightline.session import cut_lineage

# --- Fixed values ----------------------------------------------------------------------------------
SAME_PICTURE = 8
PRIOR_SIGHTINGS, PRIOR_SIMILARITY = 5, 0.92
NEAREST_DEFAULT, NEAREST_SIMILARITY = 5, 0.90
MOST_PROBES = 128         # neighbour keys of a hash: with more, comparing is cheaper than probing
BLOCK_HASHES = 16_384     # about, of each side, that meet in one task
TILE_ROWS, TILE_COLUMNS = 32, 8192    # of a block that are compared at once
MOST_TASKS = 4096
# ---------------------------------------------------------------------------------------------------


# ------------------------------------------------------------------------------ Hamming neighbours

def _slices(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` near-equal slices of a 64-bit hash."""
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def slice_plan(distance: int, index_rows: int) -> int:
    """Slice count with the least work: neighbour keys to probe against rows met per key."""
    def work(n):
        width, m = 64 // n, distance // n
        keys = sum(math.comb(width, i) for i in range(m + 1))
        return n * keys * (1 + index_rows / 2 ** width)

    return min((2, 3, 4, 5, 6), key=work)


def _flips(width: int, m: int) -> list[int]:
    """Every mask of at most ``m`` set bits within ``width`` bits."""
    return [sum(1 << b for b in bits) for i in range(m + 1) for bits in combinations(range(width), i)]


def _slice_of(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def hash_values(df: DataFrame, copies: str | None = None) -> DataFrame:
    """Distinct ``(kind, hash)`` of a signature table, both kinds stacked, with the number of copies."""
    stacked = df.select(F.inline(F.array(
        F.struct(F.lit("p").alias("kind"), F.col("phash").alias("hash")),
        F.struct(F.lit("d").alias("kind"), F.col("dhash").alias("hash")),
    ))).filter(F.col("hash").isNotNull())
    if copies:
        return stacked.groupBy("kind", "hash").agg(F.count(F.lit(1)).alias(copies))
    return stacked.distinct()


def hash_pairs(queries: DataFrame, index: DataFrame, distance: int, index_rows: int | None = None) -> DataFrame:
    """Pairs of distinct hash values at most ``distance`` bits apart: ``kind, query_hash, index_hash, distance``.

    Exact. Cut into n slices, two hashes within the distance differ by at most ``distance // n`` bits in
    some slice, so the query side is expanded to all such neighbours of each slice and meets the index on
    equal slices. A pair that meets in several slices is kept in the first of them, which needs no
    shuffle to remove repeats. Identical pictures count once, whatever their number; a slice value shared
    by many hashes (flat pictures) is salted. Where that would take more than ``MOST_PROBES`` keys a hash, both
    sides are dealt into blocks instead, and every pair of blocks is compared in a task of its own.
    """
    n = slice_plan(distance, index_rows) if index_rows else 4
    m = distance // n
    cuts = _slices(n)
    if sum(len(_flips(width, m)) for _, width in cuts) > MOST_PROBES:
        return _block_pairs(queries, index, distance)
    probes = spread(queries.select("kind", F.col("hash").alias("query_hash")).distinct(), "query_hash").select(
        "kind", "query_hash", F.inline(F.flatten(F.array(*[
            _neighbours(F.col("query_hash"), no, shift, width, m) for no, (shift, width) in enumerate(cuts)
        ])))
    )
    held = index.select("kind", F.col("hash").alias("index_hash")).distinct().select(
        "kind", "index_hash", F.inline(F.array(*[
            F.struct(F.lit(no).alias("slice_no"), _slice_of(F.col("index_hash"), shift, width).alias("slice"))
            for no, (shift, width) in enumerate(cuts)
        ]))
    )
    # The optimizer takes the expanded probes for as small as what they came from; they are never broadcast.
    met = salted_join(held, probes, ["kind", "slice_no", "slice"], spread=["index_hash"], few_hint="merge")
    apart = F.col("query_hash").bitwiseXOR(F.col("index_hash"))
    first = F.lit(True)
    for no, (shift, width) in enumerate(cuts):
        near = F.bit_count(_slice_of(apart, shift, width)) <= m
        first = first & ((F.col("slice_no") <= no) | ~near)
    return met.filter(first & (F.bit_count(apart) <= distance)).select(
        "kind", "query_hash", "index_hash", F.bit_count(apart).alias("distance")
    )


def _block_pairs(queries: DataFrame, index: DataFrame, distance: int) -> DataFrame:
    """:func:`hash_pairs` by comparing all: work with the product of both sides, in blocks of a fixed size."""
    sides, parts = [], []
    for df, name in ((queries, "query_hash"), (index, "index_hash")):
        side = cut_lineage(df.select("kind", F.col("hash").alias(name)).distinct())
        most = side.groupBy("kind").count().agg(F.max("count").alias("n")).first()["n"] or 0
        sides.append(side)
        parts.append(max(1, math.ceil(most / BLOCK_HASHES)))
    key = ["kind", "query_block", "index_block"]
    tasks = min(MOST_TASKS, 2 * parts[0] * parts[1])

    def dealt(side: DataFrame, value: str, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
        block = F.pmod(F.xxhash64(value), F.lit(own_parts)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1))).alias(other)
        return side.select("kind", value, block, every).repartition(tasks, *key)

    left = dealt(sides[0], "query_hash", "query_block", parts[0], "index_block", parts[1])
    right = dealt(sides[1], "index_hash", "index_block", parts[1], "query_block", parts[0])

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        kinds = pa.schema([("kind", pa.string()), ("query_hash", pa.int64()), ("index_hash", pa.int64()), ("distance", pa.int32())])
        if not asked.num_rows or not held.num_rows:
            return kinds.empty_table()
        # Unsigned: numpy counts the bits of a negative number's absolute value.
        a, b = (t.column(c).to_numpy().view(np.uint64) for t, c in ((asked, "query_hash"), (held, "index_hash")))
        found = []
        for i in range(0, len(a), TILE_ROWS):
            for j in range(0, len(b), TILE_COLUMNS):
                bits = np.bitwise_count(a[i:i + TILE_ROWS, None] ^ b[None, j:j + TILE_COLUMNS])
                near = np.flatnonzero(bits <= distance)
                if len(near):
                    row, column = np.divmod(near, bits.shape[1])
                    found.append((a[i + row], b[j + column], bits.ravel()[near]))
        if not found:
            return kinds.empty_table()
        q, h, d = (np.concatenate(x) for x in zip(*found))
        kind = pa.repeat(asked.column("kind")[0], len(q))
        return pa.table([kind, pa.array(q.view(np.int64)), pa.array(h.view(np.int64)), pa.array(d.astype(np.int32))], schema=kinds)

    met = left.groupBy(*key).cogroup(right.groupBy(*key))
    return met.applyInArrow(compare, "kind string, query_hash bigint, index_hash bigint, distance int")


def _neighbours(value: Column, no: int, shift: int, width: int, m: int) -> Column:
    # One constant: Catalyst folds the split and the cast away.
    masks = F.split(F.lit(",".join(map(str, _flips(width, m)))), ",").cast("array<bigint>")
    own = _slice_of(value, shift, width)
    return F.transform(masks, lambda mask: F.struct(F.lit(no).alias("slice_no"), own.bitwiseXOR(mask).alias("slice")))


def near_duplicates(
    queries: DataFrame, index: DataFrame, distance: int = SAME_PICTURE, index_rows: int | None = None
) -> DataFrame:
    """Indexed pictures within ``distance`` of each query by either hash: ``query_id, media_hash, distance``.

    ``queries``: ``query_id, phash, dhash``; ``index``: ``media_hash, phash, dhash``. The hash-level pairs
    are found first; ids are attached last, by merging: two rows of each picture are more than the optimizer takes
    them for, so the tables of ids are never broadcast.
    """
    pairs = hash_pairs(hash_values(queries), hash_values(index), distance, index_rows)

    def keyed(df, id_col, name):
        return df.select(id_col, F.inline(F.array(
            F.struct(F.lit("p").alias("kind"), F.col("phash").alias(name)),
            F.struct(F.lit("d").alias("kind"), F.col("dhash").alias(name)),
        ))).filter(F.col(name).isNotNull())

    asked = salted_join(keyed(queries, "query_id", "query_hash"), pairs, ["kind", "query_hash"], spread=["query_id"], few_hint="merge")
    found = salted_join(keyed(index, "media_hash", "index_hash"), asked, ["kind", "index_hash"], spread=["media_hash"], few_hint="merge")
    return found.groupBy("query_id", "media_hash").agg(F.min("distance").alias("distance"))


# -------------------------------------------------------------------------------- nearest vectors

def nearest(
    queries: DataFrame, index: DataFrame | VectorIndex, k: int = NEAREST_DEFAULT, min_similarity: float = NEAREST_SIMILARITY,
    probe_cells: int | None = None, exclude_self: bool = False, fold_copies: bool = True,
) -> DataFrame:
    """The ``k`` most similar indexed vectors of each query with cosine at least ``min_similarity``:
    ``query_id, media_hash, similarity, rank``. Ties go to the smaller id.

    ``queries``: ``query_id, embedding``; ``index``: a stored :class:`VectorIndex`, or a table of ``media_hash, embedding``
    that is stored as one first. The answer is exact; ``probe_cells`` limits a query to its nearest cells for the
    approximate form. A floor of 0.5 or less is refused: at angles of 60 degrees and more, cells overlap so widely that
    hardly one could be skipped.

    ``fold_copies`` keeps the k smallest ids of identical vectors of a table, which no top-k answer can exceed.
    """
    if math.acos(max(-1.0, min(1.0, min_similarity))) + SLACK >= math.pi / 3:
        raise ValueError("min_similarity must be above 0.5: below it nearly every pair would be compared")
    if not isinstance(index, VectorIndex):
        kept = index.select("media_hash", "embedding").filter(F.col("embedding").isNotNull())
        if fold_copies:
            # The hash is sorted on first, so whole vectors are compared within copies alone.
            named = kept.withColumn("_h", F.xxhash64("embedding"))
            kept = top_rows(named, ["_h", "embedding"], [F.col("media_hash")], k + int(exclude_self)).drop("_rn", "_h")
        index = VectorIndex.create(kept)
    return index.search(queries, k, min_similarity, probe_cells, exclude_self)


def prior_sightings(queries: DataFrame, index: DataFrame) -> DataFrame:
    """What the index already knows about a picture: five nearest at .92, those with an origin link."""
    top = nearest(queries, index, PRIOR_SIGHTINGS, PRIOR_SIMILARITY)
    known = index.select("media_hash", "source", "ref_url", F.col("created_at").alias("seen_at"))
    return top.join(known, "media_hash").filter(F.coalesce("ref_url", F.lit("")) != "").select(
        "query_id", "media_hash", F.round("similarity", 3).alias("similarity"), "source", "ref_url", "seen_at"
    )


def remember_origins(queries: DataFrame, origins: DataFrame) -> DataFrame:
    """Index rows for the searched pictures, with the confirmed origin when there is one.

    ``queries``: ``inv_id`` and signature columns; ``origins``: ``inv_id, first_seen``.
    """
    found = queries.join(origins.select("inv_id", F.col("first_seen.url").alias("ref_url")), "inv_id", "left")
    return found.withColumn("source", F.when(F.col("ref_url").isNotNull(), "sighting").otherwise("query")).drop("inv_id")


def best_similarity(comparisons: DataFrame, page_vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Cosine of listed pairs only: ``comparisons`` names the pairs, vectors are attached by key."""
    return comparisons.join(page_vectors, "image_url").join(query_vectors, "inv_id").withColumn(
        "similarity", vectors.cosine(F.col("image_embedding"), F.col("query_embedding"))
    ).drop("image_embedding", "query_embedding")
