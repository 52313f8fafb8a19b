"""Stored inverted file over picture embeddings: cells under super-cells, each with the angles measured in it."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.skew import top_rows
from sightline.session import shared_folder

# --- Fixed values ----------------------------------------------------------------------------------
MOST_CELLS = 16_384       # cells grow with the square root of the index up to here: the table of centres is bounded
SAMPLE_PER_CELL, MOST_SAMPLE = 16, 65_536   # rows that the centres are fitted on; every row is placed
ROUNDS = 3
BLOCK_ROWS = 4096         # of one ring that meet a batch of queries in one task
BATCH_QUERIES = 2048      # about
SEED_CELLS = 2            # that a query sees first, for the similarity which all further cells must reach
MOST_RINGS = 96           # that a query is sent to one by one; one that more can answer meets the index in shelves
SHELF_VALUES = 8_388_608  # numbers of a shelf of vectors, of either side, in one task
FEWEST_OF_SHELF, SHELVES = 8192, 4     # rows of a shelf, at least; pairs of shelves for each core, where there is work for them
TILE_QUERIES, TILE_ROWS = 256, 2048    # multiplied at once
FEWEST_PAIRS = 1 << 20    # that are worth a look at a few numbers of each vector first
LOOK_QUERIES, LOOK_ROWS = 256, 1024    # of a sample that tells how many numbers
PAIR_COST = 6000          # of a pair multiplied alone, in numbers of a pair multiplied in a tile
FEW = 16                  # a tile with fewer open pairs than one in so many has them multiplied alone
MOST_TASKS = 4096
SLACK = 1e-6              # of an angle, for rounding
SAME = 1e-11              # similarities, which are rounded to 12 digits, may differ by less when multiplied in another order
RING, RINGS = 0.08, 64    # width in radians of a ring of a cell, and more of them than there can be
# ---------------------------------------------------------------------------------------------------


def unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical means after a few rounds, from the first ``n`` rows of the sample; unused centres stay."""
    centres = sample[:n].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[i:i + 8192] @ centres.T).argmax(1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        moved = unit(sums)
        used = np.linalg.norm(moved, axis=1) > 0
        centres[used] = moved[used]
    return centres


@dataclass
class Cells:
    """Centres, and the filled rings of their cells: never more than ``MOST_CELLS`` times ``RINGS`` rows."""
    centre: np.ndarray
    above: np.ndarray     # the super-cell of each cell
    top: np.ndarray       # centres of the super-cells
    ring: np.ndarray      # cell * RINGS + number of the ring, in order
    n: np.ndarray
    low: np.ndarray       # least and greatest angle between a ring's vectors and the cell's centre
    high: np.ndarray

    def __post_init__(self):
        self.cell = self.ring // RINGS
        self.members = [np.flatnonzero(self.above[self.cell] == s) for s in range(len(self.top))]
        # No vector of a super-cell is farther from its centre than its cell's centre and that ring's outer angle.
        self.radius = np.array([max((angles(self.top[[s]], self.centre[self.cell[m]])[0] + self.high[m]), default=-1.0) for s, m in enumerate(self.members)])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A ring for each unit vector, of a cell sought under its nearest super-cell, and the angle to the cell's centre."""
        sup = (x @ self.top.T).argmax(1)
        cell = np.zeros(len(x), np.int64)
        for s in np.unique(sup):
            under, own = np.flatnonzero(self.above == s), sup == s
            if not len(under):
                under = np.arange(len(self.centre))
            cell[own] = under[(x[own] @ self.centre[under].T).argmax(1)]
        angle = np.arccos(np.clip((x * self.centre[cell]).sum(1), -1, 1))
        return cell * RINGS + (angle // RING).astype(np.int64), angle

    def nearest(self, q: np.ndarray, most: int) -> list[np.ndarray]:
        """The filled rings of the cells with the nearest centres, as places in ``ring``."""
        filled = np.unique(self.cell)
        near, rows, order = q @ self.centre[filled].T, np.arange(len(q)), []
        for _ in range(min(most, len(filled))):
            order.append(near.argmax(1))
            near[rows, order[-1]] = -np.inf
        first, last = np.searchsorted(self.cell, filled), np.searchsorted(self.cell, filled, "right")
        return [np.concatenate([np.arange(first[c], last[c]) for c in r]) for r in np.sort(np.array(order).T, axis=1)]

    def within(self, q: np.ndarray, reach: np.ndarray, most: int) -> list[np.ndarray | None]:
        """The rings that can hold a vector within ``reach`` (an angle per query): super-cells first, then by the angles
        that the ring's vectors lie between. None for a query with more than ``most`` of them."""
        rows, places, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(q), np.int64)
        apart = angles(q, self.top)
        for s, members in enumerate(self.members):
            asked = np.flatnonzero((apart[:, s] - self.radius[s] <= reach) & (n <= most)) if len(members) else []
            if len(asked):
                a = angles(q[asked], self.centre[self.cell[members]])
                gap = np.maximum(np.maximum(self.low[members] - a, a - self.high[members]), 0)
                r, c = np.nonzero(gap <= reach[asked, None])
                n[asked] += np.bincount(r, minlength=len(asked))
                rows.append(asked[r])
                places.append(members[c])
        row, place = np.concatenate(rows), np.concatenate(places)
        parts = np.split(place[np.argsort(row, kind="stable")], np.cumsum(n)[:-1])
        return [part if many <= most else None for part, many in zip(parts, n)]


def best_of(q: np.ndarray, h: np.ndarray, sim: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` most similar hits of each query; ties go to the lower rank."""
    order = np.lexsort((rank[h], -sim, q))
    q, h, sim = q[order], h[order], sim[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    best = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < k
    return q[best], h[best], sim[best]


def true_places(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a flattened mask, eight looked at at once."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    word = np.flatnonzero(flat.view(np.uint64))
    r, c = np.nonzero(flat.reshape(-1, 8)[word])
    return word[r] * 8 + c


def heads(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrow single-precision matrices whose product is not negative wherever that of ``x`` and ``y`` (rows of length one
    at most) reaches ``least``: some columns, and the length of the rest of each row, as products of the rests are at most
    those of their lengths. A sample of the rows tells how many columns leave the least work; all columns are a choice too."""
    dim = x.shape[1]
    columns = np.argsort(-(np.einsum("ij,ij->j", x, x) + np.einsum("ij,ij->j", y, y)), kind="stable")
    slack = SLACK + (dim + 16) * 2.0 ** -22   # for rounding to single precision

    def narrow(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        head = rows[:, columns[:width]]
        rest = np.einsum("ij,ij->i", rows, rows) - np.einsum("ij,ij->i", head, head)
        return head, np.sqrt(np.maximum(rest, 0)) + 1e-7 if width < dim else np.zeros(len(rows))

    few_x, few_y = (rows[::-(-len(rows) // most)] for rows, most in ((x, LOOK_QUERIES), (y, LOOK_ROWS)))
    bar, best = least[::-(-len(x) // LOOK_QUERIES), None] - slack, (np.inf, dim)
    for width in [*range(8, dim, max(8, dim // 32)), dim]:
        (a, rest_a), (b, rest_b) = narrow(few_x, width), narrow(few_y, width)
        best = min(best, (width + PAIR_COST * np.count_nonzero(a @ b.T + rest_a[:, None] * rest_b >= bar) / (len(a) * len(b)), width))
    (a, rest_a), (b, rest_b) = narrow(x, best[1]), narrow(y, best[1])
    return np.column_stack([a, rest_a, slack - least]).astype(np.float32), np.column_stack([b, rest_b, np.ones(len(b))]).astype(np.float32)


def hits(x: np.ndarray, y: np.ndarray, least: np.ndarray):
    """Rows of ``x`` and of ``y`` and their product, a tile at a time, wherever it reaches ``least`` (one for each row of x)
    less the slack for rounding."""
    narrow = heads(x, y, least) if len(x) * len(y) >= FEWEST_PAIRS else None
    step = max(1, FEWEST_PAIRS // x.shape[1])
    for i in range(0, len(x), TILE_QUERIES):
        for j in range(0, len(y), TILE_ROWS):
            own, rows = x[i:i + TILE_QUERIES], y[j:j + TILE_ROWS]
            open_ = true_places(narrow[0][i:i + TILE_QUERIES] @ narrow[1][j:j + TILE_ROWS].T >= 0) if narrow else None
            if open_ is None or len(open_) * FEW > len(own) * len(rows):
                sims = own @ rows.T
                q, h = np.divmod(np.flatnonzero(sims >= least[i:i + TILE_QUERIES, None] - SLACK), len(rows))
                sim = sims[q, h]
            else:
                q, h = np.divmod(open_, len(rows))
                sim = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", own[q[k:k + step]], rows[h[k:k + step]]) for k in range(0, len(q), step))])
                fit = sim >= least[q + i] - SLACK
                q, h, sim = q[fit], h[fit], sim[fit]
            if len(q):
                yield q + i, h + j, sim


class VectorIndex:
    """Vectors stored once by cell: written by :meth:`create`, added to by :meth:`append`, asked by :meth:`search`.

    A cell's vectors lie in rings by their angle to its centre. Three tables under ``path``: ``vectors`` (``media_hash,
    embedding`` of length one, ``ring, angle``; files hold runs of rings), ``centres``, and ``measures``, to which each
    batch adds its counts and angles."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, rows: DataFrame, path: str | None = None) -> VectorIndex:
        """An index of ``rows`` (``media_hash, embedding``; rows without an embedding are left out)."""
        index = cls(rows.sparkSession, path or f"{shared_folder(rows.sparkSession)}/sightline-vectors-{uuid.uuid4().hex}")
        rows = rows.filter(F.col("embedding").isNotNull())
        n = rows.count()
        cells = max(1, min(MOST_CELLS, round(math.sqrt(n))))
        sample = rows.select("embedding", F.xxhash64("media_hash").alias("h")).orderBy("h").limit(min(MOST_SAMPLE, cells * SAMPLE_PER_CELL)).collect()
        sample = unit(np.array([r["embedding"] for r in sample], np.float64)) if sample else np.zeros((1, 1))
        centre = centres_of(sample, min(cells, len(sample)))
        top = centres_of(centre, max(1, round(math.sqrt(len(centre)))))
        above = (centre @ top.T).argmax(1)
        stored = [(c, int(s), v.tolist()) for c, (s, v) in enumerate(zip(above, centre))] + [(-1 - s, s, v.tolist()) for s, v in enumerate(top)]
        index.spark.createDataFrame(stored, "cell int, above int, centre array<double>").coalesce(1).write.parquet(f"{index.path}/centres")
        index.append(rows)
        return index

    def append(self, rows: DataFrame) -> None:
        """Adds a batch of ``media_hash, embedding``; nothing that is stored is read or written again."""
        shared = self.spark.sparkContext.broadcast(self.cells(measured=False))

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    x = unit(rows_of(batch.column(1)))
                    ring, angle = shared.value.place(x)
                    kept = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                    yield pa.record_batch([batch.column(0), kept, pa.array(ring, pa.int32()), pa.array(angle)], ["media_hash", "embedding", "ring", "angle"])

        kind = rows.schema["media_hash"].dataType.simpleString()
        batch, part = rows.filter(F.col("embedding").isNotNull()).select("media_hash", F.col("embedding").cast("array<double>").alias("embedding")), uuid.uuid4().hex
        placed = batch.mapInArrow(place, f"media_hash {kind}, embedding array<double>, ring int, angle double")
        # A ring with a large share of the rows is dealt out by the hash, in the files as in the search.
        placed.repartitionByRange(F.col("ring"), F.xxhash64("media_hash")).sortWithinPartitions("ring").write.parquet(f"{self.path}/vectors/batch={part}")
        added = self.spark.read.parquet(f"{self.path}/vectors/batch={part}")
        added.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).coalesce(1).write.parquet(f"{self.path}/measures/batch={part}")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors").drop("batch")

    def cells(self, measured: bool = True) -> Cells:
        """The table of cells, which has a bounded size, on the driver."""
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect())
        below, top = [r for r in rows if r["cell"] >= 0], sorted((r for r in rows if r["cell"] < 0), key=lambda r: r["above"])
        seen = []
        if measured:
            seen = sorted(self.spark.read.parquet(f"{self.path}/measures").groupBy("ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
        ring, n = (np.array([r[c] for r in seen], np.int64) for c in ("ring", "n"))
        low, high = (np.array([r[c] for r in seen], float) for c in ("low", "high"))
        return Cells(np.array([r["centre"] for r in below]), np.array([r["above"] for r in below]), np.array([r["centre"] for r in top]), ring, n, low, high)

    def search(self, queries: DataFrame, k: int, floor: float, probe_cells: int | None = None, exclude_self: bool = False) -> DataFrame:
        """The ``k`` most similar stored vectors of each query with cosine at least ``floor``: ``query_id, media_hash,
        similarity, rank``; ties go to the smaller id. ``queries``: ``query_id, embedding``.

        Two passes. Each query sees its nearest cells first; its k-th similarity there is what any other cell must be
        able to reach, by the angles measured in it, to be seen in the second pass. A query that more than ``MOST_RINGS``
        rings could answer is not sent to each of them, but compared with all vectors, in shelves. The answer is exact. With
        ``probe_cells`` there is one pass over so many nearest cells, and the answer is approximate."""
        return self._search(queries, k, floor, probe_cells, exclude_self)[0]

    def visited(self, queries: DataFrame, k: int, floor: float, probe_cells: int | None = None) -> DataFrame:
        """``query_id, blocks, all_blocks``: how many of the index's blocks each query meets in :meth:`search`; one without
        a list of rings meets all of them."""
        _, requests, parts = self._search(queries, k, floor, probe_cells, False)
        listed = F.coalesce(F.aggregate("parts", F.lit(0), lambda n, p: n + p), F.lit(int(parts.sum())))
        return requests.groupBy("query_id").agg(F.least(F.sum(listed), F.lit(int(parts.sum()))).alias("blocks")).withColumn("all_blocks", F.lit(int(parts.sum())))

    def _search(self, queries: DataFrame, k: int, floor: float, probe_cells: int | None, exclude_self: bool):
        cells = self.cells()
        parts = -(-cells.n // BLOCK_ROWS)
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(float(floor)).alias("least")).filter(F.col("embedding").isNotNull())
        seeds = self._requests(asked, cells, parts, probe_cells or SEED_CELLS, True)
        order = [F.desc("similarity"), F.col("media_hash")]
        found = self._meet(seeds, k, floor, exclude_self)
        if probe_cells:
            return top_rows(found, ["query_id"], order, k, "rank"), seeds, parts
        found = self._stored(top_rows(found, ["query_id"], order, k).drop("_rn"))
        last = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("similarity").alias("_last")).filter(F.col("_n") == k).drop("_n")
        asked = asked.join(last, "query_id", "left").select("query_id", "embedding", F.greatest("least", F.coalesce(F.col("_last") - SAME, "least")).alias("least"))
        more = self._requests(asked, cells, parts, SEED_CELLS, False)
        broad = more.filter(F.col("rings").isNull())
        listed = found.join(broad.select("query_id"), "query_id", "left_anti").unionByName(self._meet(more, k, floor, exclude_self))
        whole = listed.unionByName(self._meet_all(broad, cells, k, floor, exclude_self))
        return top_rows(whole, ["query_id"], order, k, "rank"), seeds.unionByName(more), parts

    def _stored(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/sightline-vectors-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _requests(self, asked: DataFrame, cells: Cells, parts: np.ndarray, seeds: int, first: bool) -> DataFrame:
        """``query_id, embedding`` (of length one)``, least, rings, parts``: a row per query with the rings that it sees and
        their numbers of parts. The nearest cells ``first``, then all others within reach of its least similarity; null
        instead of more than ``MOST_RINGS``."""
        shared = self.spark.sparkContext.broadcast((cells, parts))
        kind = asked.schema["query_id"].dataType.simpleString()

        def lists(seen, values):
            return pa.array([None if s is None else values[s] for s in seen], pa.list_(pa.int32()))

        def run(batches):
            cells, parts = shared.value
            for batch in batches:
                if not batch.num_rows or not len(cells.n):
                    continue
                q = unit(rows_of(batch.column(1)))
                for i in range(0, len(q), BATCH_QUERIES):
                    own, rows = q[i:i + BATCH_QUERIES], batch.slice(i, BATCH_QUERIES)
                    seen = near = cells.nearest(own, seeds)
                    if not first:
                        within = cells.within(own, np.arccos(np.clip(rows.column(2).to_numpy(), -1, 1)) + SLACK, MOST_RINGS)
                        seen = [None if w is None else np.setdiff1d(w, n) for w, n in zip(within, near)]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.ravel()))
                    yield pa.record_batch([rows.column(0), vectors, rows.column(2), lists(seen, cells.ring), lists(seen, parts)], ["query_id", "embedding", "least", "rings", "parts"])

        return self._stored(asked.select("query_id", "embedding", "least").mapInArrow(run, f"query_id {kind}, embedding array<double>, least double, rings array<int>, parts array<int>"))

    def _meet(self, requests: DataFrame, k: int, floor: float, exclude_self: bool) -> DataFrame:
        """``query_id, media_hash, similarity``: the best ``k`` of every query and block. A block of a ring and a batch of
        the queries that ask for it, both bounded, meet in one task; rings that nobody asks for do not leave their scan."""
        held = self.vectors()
        asked = requests.select("query_id", "embedding", "least", F.inline(F.arrays_zip("rings", "parts"))).withColumnRenamed("rings", "ring")
        # At most as many rows as there are rings: bounded, so that neither side is shuffled to be dealt out.
        layout = F.broadcast(asked.groupBy("ring", "parts").agg(F.ceil(F.count(F.lit(1)) / BATCH_QUERIES).cast("int").alias("salts")))
        salted = F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int").alias("salt")
        left = asked.join(layout.select("ring", "salts"), "ring").select("query_id", "embedding", "least", "ring", salted, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        part = F.pmod(F.xxhash64("media_hash"), F.col("parts")).cast("int").alias("part")
        right = held.join(layout, "ring").select("media_hash", "embedding", "ring", part, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return self._multiplied(left, right, ["ring", "part", "salt"], k, floor, exclude_self)

    def _meet_all(self, asked: DataFrame, cells: Cells, k: int, floor: float, exclude_self: bool) -> DataFrame:
        """:meth:`_meet` of queries with all vectors: a shelf of each, both bounded, meet in one task."""
        sizes, cores = (asked.count(), int(cells.n.sum())), self.spark.sparkContext.defaultParallelism
        rows = min(max(1, SHELF_VALUES // cells.centre.shape[1]), max(FEWEST_OF_SHELF, math.ceil(math.sqrt(sizes[0] * sizes[1] / (SHELVES * cores)))))
        n_asked, n_held = (max(1, math.ceil(n / rows)) for n in sizes)
        # More tasks than pairs of shelves, so that few tasks get two.
        key, tasks = ["asked_shelf", "held_shelf"], min(MOST_TASKS, SHELVES * n_asked * n_held)

        def dealt(df, value, own, n_own, other, n_other):
            return df.withColumns({own: F.pmod(F.xxhash64(value), F.lit(n_own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))}).repartition(tasks, *key)

        left = dealt(asked.select("query_id", "embedding", "least"), "query_id", "asked_shelf", n_asked, "held_shelf", n_held)
        right = dealt(self.vectors().select("media_hash", "embedding"), "media_hash", "held_shelf", n_held, "asked_shelf", n_asked)
        return self._multiplied(left, right, key, k, floor, exclude_self)

    def _multiplied(self, left: DataFrame, right: DataFrame, key: list[str], k: int, floor: float, exclude_self: bool) -> DataFrame:
        """``query_id, media_hash, similarity``: the best ``k`` of every query among the rows of the same ``key``."""
        id_type, query_type = right.schema["media_hash"].dataType.simpleString(), left.schema["query_id"].dataType.simpleString()

        def multiply(asked: pa.Table, rows: pa.Table) -> pa.Table:
            kinds = pa.schema([("query_id", asked.schema.field("query_id").type), ("media_hash", rows.schema.field("media_hash").type), ("similarity", pa.float64())])
            if not asked.num_rows or not rows.num_rows:
                return kinds.empty_table()
            ids, own = (t.column(c).to_numpy(zero_copy_only=False) for t, c in ((rows, "media_hash"), (asked, "query_id")))
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            least = np.maximum(floor, asked.column("least").to_numpy())
            x, y = rows_of(asked.column("embedding")), rows_of(rows.column("embedding"))
            none = best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            found, at = [], 0
            for q, h, sim in hits(x, y, least):
                if q[0] // TILE_QUERIES != at:   # the next queries
                    found.append(best)
                    best, at = none, q[0] // TILE_QUERIES
                sim = np.round(sim, 12)
                fit = sim >= least[q]
                if exclude_self:
                    fit &= own[q] != ids[h]
                if fit.any():
                    best = best_of(*(np.concatenate(b) for b in zip(best, (q[fit], h[fit], sim[fit]))), rank, k)
            q, h, sim = (np.concatenate(f) for f in zip(*found, best))
            return pa.table([asked.column("query_id").take(pa.array(q)), rows.column("media_hash").take(pa.array(h)), pa.array(sim)], schema=kinds)

        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(multiply, f"query_id {query_type}, media_hash {id_type}, similarity double")
