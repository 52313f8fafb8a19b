"""Hard negatives of picture embeddings by an inverted multi-index: half-space codebooks, cells, certified windows."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import settle
from sightline.operators.skew import top_rows

# ---------------------------------------------------------------------------------------- Fixed values
SCALE = 256.0
LARGEST = 1 << 24         # of a scaled component; what lies beyond counts as this
ENTRIES = 16              # of each half's codebook: 256 cells
#: The codebooks are fitted on so many rows, those with the smallest hashes of their ids. Every row is in the index.
ROWS_LEARNED, PASSES = 4096, 6
BLOCK_ROWS = 16_384       # of the index that meet a batch of anchors in one task
BATCH_ANCHORS = 4096      # about
SEED_BLOCKS = 2           # that an anchor asks first, for the scores which the other blocks must reach
ROWS_AT_ONCE = 1024       # of visited cells whose scores are worked out together
POSITIVES, NEGATIVES = 5, 10
LEAST_SHARE, MOST_SHARE = 30, 90   # of a positive's score, in hundredths
# ---------------------------------------------------------------------------------------------------
_LOWEST, _HIGHEST = -(1 << 62), 1 << 62


@dataclass
class Codebooks:
    """Centres of the first and the second half of the vectors. Of fixed size."""
    half: int
    first: np.ndarray
    second: np.ndarray

    def place(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest centres of both halves and the distances to them."""
        out = []
        for own, book in ((x[:, :self.half], self.first), (x[:, self.half:], self.second)):
            far = (own * own).sum(1)[:, None] - 2 * own @ book.T + (book * book).sum(1)
            near = far.argmin(1)
            out += [near, np.sqrt(((own - book[near]) ** 2).sum(1))]
        return tuple(out)


def learn(sample: np.ndarray, entries: int = ENTRIES) -> Codebooks:
    """Lloyd's rounds over the sample's halves, from entries that are spread over its order."""
    half = sample.shape[1] // 2
    books = []
    for own in (sample[:, :half], sample[:, half:]):
        book = own[np.unique(np.linspace(0, len(own) - 1, min(entries, len(own))).astype(int))].copy()
        for _ in range(PASSES):
            near = ((own * own).sum(1)[:, None] - 2 * own @ book.T + (book * book).sum(1)).argmin(1)
            for k in np.unique(near):
                book[k] = own[near == k].mean(0)
        books.append(book)
    return Codebooks(half, *books)


def reach(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores of vectors ``q`` (rows) with anything within the radii of the centres, with room for
    rounding."""
    middle = q @ centre.T
    room = np.linalg.norm(q, axis=1)[:, None] * radius * (1 + 1e-9) + 1e-9 * np.abs(middle) + 0.25
    return middle - room, middle + room


@dataclass
class Cells:
    """Where the index's cells are: at most ``ENTRIES`` squared rows, whatever the number of vectors."""
    books: Codebooks
    first: np.ndarray
    second: np.ndarray
    radius: tuple[np.ndarray, np.ndarray]
    block: np.ndarray   # the first block of a cell
    blocks: np.ndarray  # over how many it is dealt

    def of_blocks(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores of every anchor with every block."""
        low, high = (a + b for a, b in zip(reach(q[:, :self.books.half], self.books.first[self.first], self.radius[0]), reach(q[:, self.books.half:], self.books.second[self.second], self.radius[1])))
        whole = int((self.block + self.blocks).max())
        least, most = np.full((len(q), whole), np.inf), np.full((len(q), whole), -np.inf)
        for c, (b, n) in enumerate(zip(self.block, self.blocks)):
            least[:, b:b + n] = np.minimum(least[:, b:b + n], low[:, [c]])
            most[:, b:b + n] = np.maximum(most[:, b:b + n], high[:, [c]])
        return least, most


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(image_vectors: DataFrame, id: str, vector: str, label: str, is_anchor: Column) -> DataFrame:
    """``id, label, x, asked``: usable vectors as integers, one row per id."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(float(LARGEST))
    x = F.transform(vector, lambda x: F.greatest(-most, F.least(most, F.floor(x.cast("double") * SCALE).cast("double"))).cast("int"))
    rows = image_vectors.filter(whole & (F.size(vector) > 0) & F.col(label).isNotNull() & F.col(id).isNotNull())
    rows = rows.select(F.col(id).alias("id"), F.struct(F.col(label).alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asked")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


def build_index(rows: DataFrame) -> tuple[DataFrame, Cells | None]:
    """The rows with their block and cell, stored, and the table of cells. A cell with many rows is dealt out to
    several blocks by a hash of the id, small ones share a block."""
    sample = rows.orderBy(F.xxhash64("id"), "id").select("x").limit(ROWS_LEARNED).collect()
    if not sample:
        return rows, None
    books = learn(np.array([r["x"] for r in sample], np.float64))
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                c1, d1, c2, d2 = shared.value.place(_rows(batch.column(2)))
                yield pa.record_batch([*batch.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(d1), pa.array(d2)], [*batch.schema.names, "c1", "c2", "d1", "d2"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.select("id", "label", "x", "asked")
    placed = settle(rows.mapInArrow(place, ", ".join(f"{c} {kind[c]}" for c in rows.columns) + ", c1 int, c2 int, d1 double, d2 double"))
    found = sorted(placed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect())
    block, blocks, at, waiting = [], [], 0, 0
    for r in found:
        if waiting and waiting + r["n"] > BLOCK_ROWS:
            at, waiting = at + 1, 0
        block.append(at)
        blocks.append(-(-r["n"] // BLOCK_ROWS))
        waiting += r["n"]
        if blocks[-1] > 1:
            at, waiting = at + blocks[-1], 0
    cells = Cells(books, *(np.array([r[c] for r in found]) for c in ("c1", "c2")), tuple(np.array([r[c] for r in found]) for c in ("d1", "d2")), np.array(block), np.array(blocks))
    layout = rows.sparkSession.createDataFrame([(r["c1"], r["c2"], b, n) for r, b, n in zip(found, block, blocks)], "c1 int, c2 int, b int, n int")
    # At most ENTRIES squared rows.
    return placed.join(F.broadcast(layout), ["c1", "c2"]).withColumn("block", F.col("b") + F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("b", "n"), cells


def ask(asked: DataFrame, cells: Cells, seed: bool) -> DataFrame:
    """One row per anchor and block that it must see. ``asked``: ``id, label, x, windows`` (slot, low, high). As
    ``seed``, the few blocks whose scores can lie nearest to the top of its highest window; otherwise all others that can
    reach a window at all."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            least, most = shared.value.of_blocks(_rows(batch.column(2)))
            windows = batch.column(3).to_pylist()
            # The seeds are chosen by the windows as they were given, before the seeds' own scores raise them.
            high, given = (np.array([[f(w[c] for w in ws)] for ws in windows], float) for f, c in ((max, "high"), (min, "given")))
            low = np.array([[min(w["low"] for w in ws)] for ws in windows], float)
            far = np.where((most >= given) & (least <= high), np.abs(np.minimum(most, 2.0**60) - np.minimum(high, 2.0**60)), np.inf)
            first = np.argsort(far, axis=1, kind="stable")[:, :SEED_BLOCKS]
            seeds = np.zeros(most.shape, bool)
            np.put_along_axis(seeds, first, True, axis=1)
            seeds &= np.isfinite(far)
            wanted = seeds if seed else (most >= low) & (least <= high) & ~seeds
            row, block = np.nonzero(wanted)
            for k in range(0, len(row), BATCH_ANCHORS):
                own = batch.take(pa.array(row[k:k + BATCH_ANCHORS]))
                yield pa.record_batch([*own.columns, pa.array(block[k:k + BATCH_ANCHORS], pa.int32())], [*own.schema.names, "block"])

    kind = {f.name: f.dataType.simpleString() for f in asked.schema}
    names = ["id", "label", "x", "windows"]
    return asked.select(*names).mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in names) + ", block int")


class Walk:
    """The inverted multi-index over one block's rows."""

    def __init__(self, books: Codebooks, rows: pa.Table):
        c1, c2 = rows.column("c1").to_numpy(), rows.column("c2").to_numpy()
        order = np.lexsort((c2, c1))
        rows = rows.take(pa.array(order))
        self.books, self.x = books, _rows(rows.column("x"))
        self.ids, self.labels = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        self.rank = np.empty(len(order), np.int64)
        self.rank[np.argsort(self.ids, kind="stable")] = np.arange(len(order))
        cell = c1[order].astype(np.int64) << 32 | c2[order]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.at = {(int(c >> 32), int(c & 0xFFFFFFFF)): (a, b) for c, a, b in zip(cell[starts], starts, np.append(starts[1:], len(cell)))}
        self.sides = []
        for c, d in (("c1", "d1"), ("c2", "d2")):
            radius = np.zeros(len(books.first if c == "c1" else books.second))
            np.maximum.at(radius, rows.column(c).to_numpy(), rows.column(d).to_numpy())
            here = np.unique(rows.column(c).to_numpy())
            self.sides.append((here, radius[here]))

    def prepare(self, q: np.ndarray) -> None:
        """Greatest and least half-scores of a batch of anchors with each half's entries; whether floats are exact."""
        half, (first, r1), (second, r2) = self.books.half, *self.sides
        self.u, self.v = reach(q[:, :half], self.books.first[first], r1), reach(q[:, half:], self.books.second[second], r2)
        self.exact = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * q.shape[1] < 2**53

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.x[rows] @ q).astype(np.int64)
        return self.x[rows].astype(np.int64) @ q.astype(np.int64)

    def search(self, k: int, q: np.ndarray, id, label, windows: list[dict], most: int, same: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each window the first ``most`` rows (places and scores) of the same or of another label.

        Cells come from a heap over both halves' entries, by the sum of the half-scores that they can reach. A window
        is certified, and asks for no more, once that sum is below its bottom or below the last of ``most`` found."""
        least1, most1, least2, most2 = self.u[0][k], self.u[1][k], self.v[0][k], self.v[1][k]
        i_order, j_order = np.argsort(-most1, kind="stable"), np.argsort(-most2, kind="stable")
        heap = [(-(most1[i] + most2[j_order[0]]), n, 0) for n, i in enumerate(i_order)]
        heapq.heapify(heap)
        low, top = {w["slot"]: w["low"] for w in windows}, max(w["high"] for w in windows)
        found = {w["slot"]: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for w in windows}
        waiting, n = [], 0
        while True:
            over = not heap or -heap[0][0] < min(low.values())
            if n >= ROWS_AT_ONCE or (over and n):
                rows = np.concatenate(waiting)
                score = self.scores(rows, q)
                fits = ((self.labels[rows] == label) == same) & (score >= min(low.values())) & (score <= top) & (self.ids[rows] != id)
                rows, score = rows[fits], score[fits]
                for w in windows if len(rows) else []:
                    s = w["slot"]
                    inside = (score >= low[s]) & (score <= w["high"])
                    mine, theirs = np.append(found[s][0], rows[inside]), np.append(found[s][1], score[inside])
                    best = np.lexsort((self.rank[mine], -theirs))[:most]
                    found[s] = mine[best], theirs[best]
                    if len(best) == most:
                        low[s] = max(low[s], int(theirs[best[-1]]))
                waiting, n = [], 0
                continue
            if over:
                return found
            _, a, b = heapq.heappop(heap)
            i, j = i_order[a], j_order[b]
            if b + 1 < len(j_order):
                heapq.heappush(heap, (-(most1[i] + most2[j_order[b + 1]]), a, b + 1))
            span = self.at.get((int(self.sides[0][0][i]), int(self.sides[1][0][j])))
            if span and least1[i] + least2[j] <= top:
                waiting.append(np.arange(*span))
                n += span[1] - span[0]


def visit(requests: DataFrame, index: DataFrame, books: Codebooks, most: int, same: bool, salts: int) -> DataFrame:
    """``id, slot, found, score``: what anchors find in the blocks they asked for. A batch of anchors and a block, both
    bounded, meet in one task."""
    kind = {f.name: f.dataType.simpleString() for f in index.schema}
    shared = index.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("id", pa.int64()), ("slot", pa.int32()), ("found", pa.int64()), ("score", pa.int64())])

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids = asked.schema.field("id").type
        typed = pa.schema([schema.field(n).with_type(ids) if n in ("id", "found") else schema.field(n) for n in schema.names])
        if not asked.num_rows or not rows.num_rows:
            return typed.empty_table()
        walk, q = Walk(shared.value, rows), _rows(asked.column("x"))
        walk.prepare(q)
        out = []
        for k, (own, label, windows) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("id", "label", "windows")))):
            for slot, (places, scores) in walk.search(k, q[k], own, label, windows, most, same).items():
                if len(places):
                    out.append(pa.table([pa.array([own] * len(places), ids), pa.array([slot] * len(places), pa.int32()), pa.array(walk.ids[places], ids), pa.array(scores)], schema=typed))
        return pa.concat_tables(out) if out else typed.empty_table()

    left = requests.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    right = index.select("id", "label", "x", "c1", "c2", "d1", "d2", "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(meet, f"id {kind['id']}, slot int, found {kind['id']}, score bigint")


def best(asked: DataFrame, index: DataFrame, cells: Cells, most: int, same: bool, salts: int) -> DataFrame:
    """``id, slot, found, score, rank``: the first ``most`` rows of every window of every anchor, exactly. The seeds' last
    scores are what the other blocks must reach."""
    asked = asked.withColumn("windows", F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), w["low"].alias("low"), w["high"].alias("high"), w["low"].alias("given"))))
    order = [F.desc("score"), F.col("found")]
    seeds = settle(top_rows(visit(ask(asked, cells, True), index, cells.books, most, same, salts), ["id", "slot"], order, most).drop("_rn"))
    last = seeds.groupBy("id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).filter(F.col("n") == most)
    last = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "last"))).alias("lasts"))  # a few slots an anchor
    raised = asked.join(last, "id", "left").withColumn("windows", F.transform("windows", lambda w: F.struct(
        w["slot"].alias("slot"), F.greatest(w["low"], F.element_at("lasts", w["slot"])).alias("low"), w["high"].alias("high"), w["given"].alias("given"))))
    rest = visit(ask(raised, cells, False), index, cells.books, most, same, salts)
    return settle(top_rows(seeds.unionByName(rest), ["id", "slot"], order, most, "rank"))


def mine_negatives(
    image_vectors: DataFrame, is_anchor: Column, id: str = "media_hash", vector: str = "embedding", label: str = "ref_url",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, most_share: int = MOST_SHARE,
) -> DataFrame:
    """For training an encoder: pictures of other origins that score just below an anchor's own.

    ``image_vectors``: ``media_hash`` (any orderable type), ``embedding``, ``ref_url``, the origin that tells which
    pictures belong together; other columns are not read. ``is_anchor`` says of a row whether negatives are mined for
    it. A score is the inner product of two vectors of integers, floor(256 x) a component, at most 2^24 in size; higher
    scores come first, ties by the smaller media_hash.

    An anchor's positives are its first ``positives`` other pictures of the same ref_url. For each, the first
    ``negatives`` pictures of another ref_url are returned whose score is from ``least_share`` to ``most_share``
    hundredths of the positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    A pair without such a picture gives no row.

    Every row lies in a cell of two half-space codebooks, which are fitted on ``ROWS_LEARNED`` rows. Cells lie in blocks;
    an anchor asks two blocks first, then all others that can still reach one of its windows, and within a block a heap
    visits cells by the sum of the half-scores that they can reach, radii included, until every window is certified: the
    result is exact. Anchors meet blocks in batches, in tasks of bounded size, whatever the share of one ref_url or
    vector.

    Rows without a media_hash, a ref_url or a vector, or with a null or non-finite component, take no part, nor do
    those whose length differs from that of the smallest media_hash. Of rows that repeat a media_hash, the first by
    ref_url and vector is read. An empty table gives an empty result."""
    rows = settle(scaled(image_vectors, id, vector, label, is_anchor))
    kind = rows.schema["id"].dataType.simpleString()
    lead = rows.orderBy("id").select(F.size("x").alias("width")).limit(1).collect()
    rows = rows.filter(F.size("x") == (lead[0]["width"] if lead else 0))
    index, cells = build_index(rows)
    if cells is None:
        return rows.select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.lit(0).cast("bigint").alias("positive_score"), F.lit(0).cast("bigint").alias("negative_score")).limit(0)
    anchors = rows.filter("asked").select("id", "label", "x")
    salts = max(1, -(-anchors.count() // BATCH_ANCHORS))
    window = F.struct(F.lit(0).alias("slot"), F.lit(_LOWEST).cast("bigint").alias("low"), F.lit(_HIGHEST).cast("bigint").alias("high"))
    near = best(anchors.withColumn("windows", F.array(window)), index, cells, positives, True, salts)
    # A negative score leaves no room: the lower end would lie above the upper one.
    low, high = F.expr(f"(score * {int(least_share)} + 99) div 100"), F.expr(f"score * {int(most_share)} div 100")
    windows = near.filter("score >= 0").select("id", F.struct(F.col("rank").alias("slot"), low.alias("low"), high.alias("high")).alias("w")).filter("w.low <= w.high")
    windows = windows.groupBy("id").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # at most ``positives`` an anchor
    far = best(anchors.join(windows, "id"), index, cells, negatives, False, salts)
    pairs = near.select("id", F.col("rank").alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(pairs, ["id", "slot"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").cast(kind).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
