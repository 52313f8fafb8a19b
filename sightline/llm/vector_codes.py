"""Codes of picture embeddings: a product codebook by Lloyd rounds that walk a tree of parts against a tree of entries."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import join_back, settle

# ---------------------------------------------------------------------------------------- Fixed values
PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024.0
LARGEST = 1 << 26         # of a scaled component; what lies beyond counts as this, so squared distances fit a long
BLOCK_ROWS = 4096         # vectors of one pair of trees
LEAF = 16                 # parts in a leaf of the tree of parts, about
PAIRS_AT_ONCE = 1 << 16   # node pairs whose bounds are worked out together
# ---------------------------------------------------------------------------------------------------


def halves(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of a halving tree over ``n`` points begin and end, level by level: every node has two children,
    every leaf one point or more and about ``leaf``."""
    levels = [np.array([0, n])]
    while (len(levels[-1]) - 1) * 2 * leaf <= n:
        at = levels[-1]
        levels.append(np.sort(np.concatenate([at, (at[:-1] + at[1:]) // 2])))
    return levels


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of points in which each node of the halving tree is split across its widest side."""
    order, levels = np.arange(len(points)), halves(len(points), leaf)
    for at, below in zip(levels, levels[1:]):
        for k in range(len(at) - 1):
            own = order[at[k]:at[k + 1]]
            held = points[own]
            side = int((held.max(0) - held.min(0)).argmax())
            order[at[k]:at[k + 1]] = own[np.argpartition(held[:, side], below[2 * k + 1] - at[k])]
    return order


@dataclass
class Tree:
    """A halving tree over ordered points: per level the nodes' bounds, boxes and cached sums, in integers."""
    points: np.ndarray
    levels: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @classmethod
    def over(cls, points: np.ndarray, leaf: int, with_sums: bool) -> Tree:
        levels = halves(len(points), leaf)
        parts = lambda f: [f.reduceat(points, at[:-1], axis=0) for at in levels]
        return cls(points, levels, parts(np.minimum), parts(np.maximum), parts(np.add) if with_sums else [])

    def level(self, depth: int) -> int:
        return min(depth, len(self.levels) - 1)


def bounds(a: Tree, i: int, of_a: np.ndarray, b: Tree, j: int, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of node pairs of two levels, exact integers of their boxes."""
    least, most = np.empty(len(of_a), np.int64), np.empty(len(of_a), np.int64)
    for k in range(0, len(of_a), PAIRS_AT_ONCE):
        own, other = of_a[k:k + PAIRS_AT_ONCE], of_b[k:k + PAIRS_AT_ONCE]
        above, below = a.high[i][own] - b.low[j][other], b.high[j][other] - a.low[i][own]
        most[k:k + PAIRS_AT_ONCE] = (np.maximum(above, below) ** 2).sum(1)
        gap = np.maximum(np.maximum(-above, -below), 0)
        least[k:k + PAIRS_AT_ONCE] = (gap ** 2).sum(1)
    return least, most


def assign(parts: Tree, entries: Tree, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part (in the tree's order), and per entry the sum and number of its parts.

    ``names``: the codebook's indexes of the entries in their tree's order. Both trees go down a level at a time. Of
    the entry nodes still open to a node of parts, those whose least distance is above the smallest greatest distance
    of any are dropped. A node left with one entry is assigned whole, by its cached sum. What is left at the leaves is
    told by integer distances, ties to the lower index."""
    n, found = len(parts.points), np.full(len(parts.points), -1, np.int64)
    sums, counts = np.zeros((len(names), parts.points.shape[1]), np.int64), np.zeros(len(names), np.int64)
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)  # open pairs, sorted by node of parts
    for depth in range(max(len(parts.levels), len(entries.levels))):
        i, j = parts.level(depth), entries.level(depth)
        least, most = bounds(parts, i, p, entries, j, e)
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        lengths = np.diff(np.append(starts, len(p)))
        stay = least <= np.repeat(np.minimum.reduceat(most, starts), lengths)
        p, e = p[stay], e[stay]
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        lengths = np.diff(np.append(starts, len(p)))
        single = (lengths == 1) & (np.diff(entries.levels[j])[e[starts]] == 1)
        for k in starts[single]:
            a, b, own = parts.levels[i][p[k]], parts.levels[i][p[k] + 1], names[entries.levels[j][e[k]]]
            found[a:b] = own
            sums[own] += parts.sums[i][p[k]]
            counts[own] += b - a
        open_ = ~np.repeat(single, lengths)
        p, e = p[open_], e[open_]
        if not len(p):
            return found, sums, counts
        if parts.level(depth + 1) > i:
            p, e = np.repeat(p, 2) * 2 + np.tile([0, 1], len(p)), np.repeat(e, 2)
        if entries.level(depth + 1) > j:
            p, e = np.repeat(p, 2), np.repeat(e, 2) * 2 + np.tile([0, 1], len(e))
        order = np.argsort(p, kind="stable")
        p, e = p[order], e[order]
    i, j = len(parts.levels) - 1, len(entries.levels) - 1
    open_ = found < 0
    # Each pair's entries, by index within a leaf of parts: the first of equal distances is the lower one.
    lengths = np.diff(entries.levels[j])[e]
    leaf, places = np.repeat(p, lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(entries.levels[j][e], lengths)
    order = np.lexsort((names[places], leaf))
    leaf, places = leaf[order], places[order]
    squares = (entries.points * entries.points).sum(1)
    starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
    for first, last in zip(starts, np.append(starts[1:], len(leaf))):
        a, b, near = parts.levels[i][leaf[first]], parts.levels[i][leaf[first] + 1], places[first:last]
        far = squares[near] - 2 * (parts.points[a:b] @ entries.points[near].T)  # the part's own square is the same for all
        found[a:b] = names[near[far.argmin(1)]]
    counts += np.bincount(found[open_], minlength=len(counts))
    for d in range(sums.shape[1]):  # below 2^53, so these sums are exact
        sums[:, d] += np.bincount(found[open_], parts.points[open_, d], len(counts)).astype(np.int64)
    assert n == counts.sum()
    return found, sums, counts


def entry_trees(codebooks: np.ndarray) -> list[tuple[Tree, np.ndarray]]:
    """A tree over each position's entries, leaves of one entry, and the indexes of the entries in its order."""
    orders = [tree_order(book, 1) for book in codebooks]
    return [(Tree.over(book[order], 1, False), order) for book, order in zip(codebooks, orders)]


def scaled(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``id, label, x``: usable vectors as integers, floor(``SCALE`` * component)."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(float(LARGEST))
    x = F.transform(vector, lambda x: F.greatest(-most, F.least(most, F.floor(x.cast("double") * SCALE).cast("double"))).cast("int"))
    return vectors.filter(whole & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0)).select(F.col(id).alias("id"), F.col(label).alias("label"), x.alias("x"))


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """The rows in blocks of :data:`BLOCK_ROWS`, as they stream by: ids, labels, and for each position the parts in the
    order of their tree, with the places they had. One block is held at a time; nothing is shuffled."""
    size = width // PARTS

    def packed(waiting):
        batch = pa.Table.from_batches(waiting).combine_chunks()
        x = batch.column("x").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, PARTS, size)
        orders = [tree_order(x[:, k].astype(np.int64), LEAF).astype(np.int32) for k in range(PARTS)]
        lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c).chunk(0)) for c in ("id", "label")]
        kept = [pa.array([[m.tobytes() for m in ms]], pa.list_(pa.binary())) for ms in (orders, [x[o, k] for k, o in enumerate(orders)])]
        return pa.record_batch([*lists, *kept], ["ids", "labels", "orders", "parts"])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, BLOCK_ROWS - n)
                waiting.append(taken)
                n, batch = n + taken.num_rows, batch.slice(taken.num_rows)
                if n == BLOCK_ROWS:
                    yield packed(waiting)
                    waiting, n = [], 0
        if n:
            yield packed(waiting)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"ids array<{kind['id']}>, labels array<{kind['label']}>, orders array<binary>, parts array<binary>")


def _trees(block: dict, size: int) -> list[Tree]:
    return [Tree.over(np.frombuffer(m, np.int32).astype(np.int64).reshape(-1, size), LEAF, True) for m in block["parts"]]


def _partial_sums(packed: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """One assignment of every part: per position and entry the number of its parts and their componentwise sums. Each
    task adds its blocks up before anything is shuffled."""
    size, n = codebooks.shape[2], codebooks.shape[1]
    shared = packed.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        books = entry_trees(shared.value)
        sums, counts = np.zeros(shared.value.shape, np.int64), np.zeros(shared.value.shape[:2], np.int64)
        for batch in batches:
            for block in batch.select(["parts"]).to_pylist():
                for k, tree in enumerate(_trees(block, size)):
                    _, s, c = assign(tree, *books[k])
                    sums[k] += s
                    counts[k] += c
        used = np.argwhere(counts > 0)
        if len(used):
            k, e = used.T
            yield pa.record_batch([pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[k, e]), *(pa.array(sums[k, e, d]) for d in range(size))], ["part", "entry", "n", *(f"s{d}" for d in range(size))])

    schema = "part int, entry int, n bigint, " + ", ".join(f"s{d} bigint" for d in range(size))
    return packed.select("parts").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(size)))


def _coded(packed: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of every vector."""
    size = codebooks.shape[2]
    shared = packed.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        books = entry_trees(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                held = block.select(["parts", "orders"]).to_pylist()[0]
                ids, labels = block.column("ids").flatten(), block.column("labels").flatten()
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for k, tree in enumerate(_trees(held, size)):
                    found, _, _ = assign(tree, *books[k])
                    order = np.frombuffer(held["orders"][k], np.int32)
                    codes[order, k] = found
                    error[order] += ((tree.points - shared.value[k][found]) ** 2).sum(1)
                yield pa.record_batch([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kind = {f.name: f.dataType.elementType.simpleString() for f in packed.schema if f.name in ("ids", "labels")}
    return packed.mapInArrow(run, f"id {kind['ids']}, label {kind['labels']}, code string, error bigint")


def codebooks_text(codebooks: np.ndarray) -> str:
    """All integers of the entries by position, entry, place within the entry."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def fit_codebooks(packed: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (positions x entries x components) after ``rounds`` rounds from ``first``; entries that no part chose
    stay. A round is one pass over the stored blocks, of which one row per position and entry comes back."""
    books = first.copy()
    for _ in range(rounds if books.shape[1] else 0):
        for row in _partial_sums(packed, books).collect():
            books[row["part"], row["entry"]] = [row[f"s{d}"] // row["n"] for d in range(books.shape[2])]
    return books


def compress_vectors(
    image_vectors: DataFrame, id: str = "media_hash", vector: str = "embedding", label: str = "source", entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """Short codes of the stored picture embeddings: one byte for each of four parts of a vector.

    ``image_vectors``: ``media_hash`` (any orderable type), ``embedding``, ``source``; other columns are not read.
    Returns one row per usable vector: ``media_hash, source, code, error, label_error, codebooks_sha256``. ``code`` has
    two hex digits a part, ``error`` is the squared distance to the coded vector in units of 1/1024, ``label_error`` its
    sum over the rows of one source (rows without one together).

    Every component becomes floor(1024 x), at most 2^26 in size. Each position's codebook begins with that part of the
    ``entries`` smallest media_hashes (nulls last, then by vector) and is moved ``rounds`` times to the floor of its
    parts' means. All arithmetic is in integers, so the result does not depend on how rows are dealt out to tasks.

    A vector that is null or empty, or holds a null or non-finite component, takes no part; nor does one whose length
    is no multiple of four, or differs from that of the smallest media_hash. Rows that repeat are coded each. With fewer
    vectors than ``entries`` the codebooks are as short. An empty table gives an empty result."""
    spark = image_vectors.sparkSession
    rows = scaled(image_vectors, id, vector, label)
    lead = rows.orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x").alias("width")).limit(1).collect()
    width = lead[0]["width"] if lead else PARTS
    rows = rows.filter(F.size("x") == width)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    first = np.array([r["x"] for r in first], np.int64).reshape(-1, PARTS, width // PARTS).transpose(1, 0, 2)
    packed = settle(blocks(rows, width))
    books = fit_codebooks(packed, first, rounds)
    if not books.shape[1]:
        coded = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    else:
        coded = settle(_coded(packed, books))
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = join_back(coded, errors, ["label"], "code")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return out.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
