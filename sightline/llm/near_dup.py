"""Jaccard join of texts on word shingles by PartEnum signatures, as classes and components."""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import components, forget, join_back, mix, on_bytes, row_shingles, settle

# ---------------------------------------------------------------------------------------- Fixed values
SHINGLE_WORDS, SIMILARITY = 5, Fraction(4, 5)
#: Second-level parts of a first-level part, and how many of them a signature leaves out. More of both make signatures
#: more selective and more numerous: raise them with the number of texts.
PARTS, LEFT_OUT = 3, 1
SIGNATURE_ROWS = 1 << 16  # signatures in one Arrow batch, about
FEWEST_PARTS, MOST_PARTS = 32, 1 << 16   # of a profile; one or two parts a shingle
FEWEST_FOLDS, FOLD = 256, 4   # the short profile that goes with every pair: so many parts, or a quarter of the profile's
PAIR_ROWS = 256           # pairs in one Arrow batch where both sides carry whole texts or profiles
FOLD_ROWS = 2048          # where they carry short profiles
LIGHT = 1                 # features; what a signature of so few stands for is shared by chance
BLOCK_MEMBERS = 2048      # of a hub's members that meet in one task
TILE_MEMBERS = 256        # of them that are held against a block at once
SMALL_GROUP = 32          # members of groups that are gone through together
LEVELS = 15               # of the counts of a part that are told apart before pairs are looked at one by one
PAIR_VALUES = 1 << 22     # numbers of profiles of pairs looked at at once, of either side
# ---------------------------------------------------------------------------------------------------


class PartEnum:
    """Signatures of sets such that any two sets of similarity ``at_least`` share one.

    Sizes fall into bands whose ends are ``1 / at_least`` apart, so that similar sets lie in one band or in neighbours; a
    set gets the signatures of its own band and of the next. Within a band whose largest size is r, similar sets differ
    in at most k = 2 r (1 - s) / (1 + s) elements. The feature domain is dealt out over n1 parts, each of ``parts``
    smaller ones; n1 (left_out + 1) > k, so some part holds at most ``left_out`` differences, and one of the choices
    that leave ``left_out`` of its smaller parts out has none: its signature is the same in both sets. A signature is odd
    if it is light: at most ``LIGHT`` features are left."""

    def __init__(self, at_least: Fraction, parts: int = PARTS, left_out: int = LEFT_OUT):
        if not 0 < at_least <= 1 or left_out >= parts:
            raise ValueError("similarity in (0, 1] and fewer parts left out than there are")
        self.at_least, self.parts, self.left_out, self.ends = at_least, parts, left_out, [1]

    def band(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append(max(self.ends[-1] + 1, int((self.ends[-1] + 1) / self.at_least)))
        return next(i for i in range(len(self.ends) - 1, -1, -1) if i == 0 or self.ends[i - 1] < size)

    def end(self, band: int) -> int:
        while len(self.ends) <= band:
            self.ends.append(max(self.ends[-1] + 1, int((self.ends[-1] + 1) / self.at_least)))
        return self.ends[band]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """``features``: distinct 64-bit hashes of a set. None for an empty set."""
        if not len(features):
            return np.zeros(0, np.uint64)
        own = self.band(len(features))
        return np.concatenate([self._of_band(features, b) for b in (own, own + 1)])

    def _of_band(self, features: np.ndarray, band: int) -> np.ndarray:
        k = int(2 * self.end(band) * (1 - self.at_least) / (1 + self.at_least))
        out = min(self.left_out, k)
        parts = self.parts if out else 1
        n1 = k // (out + 1) + 1
        # Part of each feature; the sum of the features' hashes stands for the set that a part holds.
        at = (features >> np.uint64(32)) % np.uint64(n1) * np.uint64(parts) + (features & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
        held = np.zeros(n1 * parts, np.uint64)
        at = at.astype(np.int64)
        np.add.at(held, at, mix(features + np.uint64(band)))
        many = np.bincount(at, minlength=n1 * parts).reshape(n1, parts)
        held = mix(held + np.arange(1, n1 * parts + 1, dtype=np.uint64)).reshape(n1, parts)
        total, first = held.sum(1, dtype=np.uint64), mix(np.arange(n1, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(32)))
        made = []
        for c, gone in enumerate(itertools.combinations(range(parts), out)):
            rest = total - held[:, list(gone)].sum(1, dtype=np.uint64) if gone else total
            light = (many.sum(1) - many[:, list(gone)].sum(1) <= LIGHT).astype(np.uint64)
            made.append(mix(mix(rest + np.uint64(c)) ^ first) & ~np.uint64(1) | light)
        return np.concatenate(made)


def _classes(rows: DataFrame, size: int) -> DataFrame:
    """``id, h, n_shingles, like, fold, profile``: ``like`` is a 128-bit name of the row's shingle set, null for an empty set;
    ``h`` a hash of the text."""
    def step(batch):
        n, names, short, whole = [], [], [], []
        for s in row_shingles(batch.column(1), size):
            n.append(len(s))
            names.append(np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes() if len(s) else None)
            short.append(fold(s) if len(s) else None)
            whole.append(profile(s) if len(s) else None)
        kept = [pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (names, short, whole))]
        yield pa.record_batch([batch.column(0), batch.column(2), *kept], ["id", "h", "n_shingles", "like", "fold", "profile"])

    rows = rows.select("id", "text_content", F.xxhash64("text_content").alias("h"))
    return on_bytes(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, h bigint, n_shingles bigint, like binary, fold binary, profile binary")


def _signatures(rows: DataFrame, size: int, scheme: PartEnum) -> DataFrame:
    def step(batch):
        signs, owners, waiting = [], [], 0
        for i, s in enumerate(row_shingles(batch.column(1), size)):
            if len(s):
                own = scheme.signatures(s)
                signs.append(own)
                owners.append(np.full(len(own), i))
                waiting += len(own)
            if signs and (waiting > SIGNATURE_ROWS or i == batch.num_rows - 1):
                yield pa.record_batch([pa.array(np.concatenate(signs).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(owners)))], ["sign", "id"])
                signs, owners, waiting = [], [], 0
        if signs:
            yield pa.record_batch([pa.array(np.concatenate(signs).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(owners)))], ["sign", "id"])

    return on_bytes(rows, step, f"sign bigint, id {rows.schema['id'].dataType.simpleString()}")


def _stars(signed: DataFrame) -> DataFrame:
    """``hub, id, sign``: for each signature, every other row that has it beside one of them, the hub. A signature's rows
    stream by in order; whatever their number, one hub is held. Pairs that repeat within a batch are sent once.
    ``sign`` is 0, or the signature if it is light and more than two rows may have it."""
    kind = signed.schema["id"].dataType.simpleString()
    names = ["hub", "id", "sign"]

    def run(batches):
        sign, hub = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            signs, ids = batch.column(0).to_numpy(), batch.column(1)
            starts = np.flatnonzero(np.append(True, signs[1:] != signs[:-1]))
            lengths = np.diff(np.append(starts, len(signs)))
            goes_on = sign is not None and signs[0] == sign
            if goes_on:  # the last batch's signature: more rows of its hub
                more = ids.slice(0, int(lengths[0])).unique()
                yield pa.record_batch([pa.array([hub] * len(more), more.type), more, pa.array([int(sign) if sign & 1 else 0] * len(more), pa.int64())], names)
            many = lengths > 1
            many[0] &= not goes_on
            keep = np.repeat(many, lengths)
            if keep.any():
                values = ids.filter(pa.array(keep))
                of = np.repeat(np.arange(len(starts)), lengths)[keep]
                _, at, rank = np.unique(values.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
                order = np.lexsort((rank, of))
                begins = np.append(True, of[order][1:] != of[order][:-1])
                hubs = rank[order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]]
                pair = hubs.astype(np.int64) << 32 | rank[order]
                # The last signature may go on in the next batch.
                own = np.where((signs[starts] & 1 == 1) & ((lengths > 2) | (np.arange(len(starts)) == len(starts) - 1)), signs[starts], 0)[of[order]]
                by = np.lexsort((own, pair))
                by = by[np.append(True, (pair[by][1:] != pair[by][:-1]) | (own[by][1:] != own[by][:-1]))]
                pair, own = pair[by], own[by]
                yield pa.record_batch([values.take(pa.array(at[pair >> 32])), values.take(pa.array(at[pair & 0xFFFFFFFF])), pa.array(own)], names)
            if len(starts) > 1 or not goes_on:
                sign, hub = signs[-1], pc.min(ids.slice(int(starts[-1]))).as_py()

    return signed.mapInArrow(run, f"hub {kind}, id {kind}, sign bigint")


def profile(features: np.ndarray) -> bytes:
    """How many features of a set lie in each part of the domain, one byte a part; 255 stands for any larger number.
    The number of parts is a power of two that follows the size, so similar sets have as many, or half or twice."""
    parts = min(MOST_PARTS, max(FEWEST_PARTS, 1 << len(features).bit_length()))
    return np.minimum(np.bincount((features & np.uint64(parts - 1)).astype(np.int64), minlength=parts), 255).astype(np.uint8).tobytes()


def fold(features: np.ndarray) -> bytes:
    """A profile of fewer parts, again a power of two, two parts a byte; 15 stands for any larger number."""
    parts = max(FEWEST_FOLDS, len(profile(features)) // FOLD)
    held = np.minimum(np.bincount((features & np.uint64(parts - 1)).astype(np.int64), minlength=parts), 15).astype(np.uint8)
    return (held[::2] | held[1::2] << 4).tobytes()


def profiles(column: pa.Array, by: str = "profile") -> np.ndarray:
    """Profiles or folds (rows x parts) of one width, the narrowest of them: parts that a narrower one joins are added up,
    and a full one stands for any number."""
    rows = column.to_pylist()
    width = min(map(len, rows))

    def counts(raw: bytes) -> np.ndarray:
        held = np.frombuffer(raw, np.uint8)
        if by == "fold":
            held = np.stack([held & 15, held >> 4], 1).ravel()
        return np.where(held == (15 if by == "fold" else 255), 1 << 20, held.astype(np.int32))

    if max(map(len, rows)) == width:
        return counts(b"".join(rows)).reshape(len(rows), -1)
    width *= 2 if by == "fold" else 1
    return np.stack([counts(r).reshape(-1, width).sum(0) for r in rows])


def may_link(mine: np.ndarray, theirs: np.ndarray, n: np.ndarray, m: np.ndarray, at_least: Fraction) -> np.ndarray:
    """Whether the profiles leave room for the similarity: a part's features have at most the lesser count in common,
    and similar sets of sizes n and m have at least s / (1 + s) (n + m)."""
    room = np.minimum(np.minimum(mine, theirs).sum(-1, dtype=np.int64), np.minimum(n, m))
    return room * (at_least.numerator + at_least.denominator) >= (n + m) * at_least.numerator


def likely_pairs(mine: np.ndarray, theirs: np.ndarray, n: np.ndarray, m: np.ndarray, at_least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``mine`` and ``theirs`` for which :func:`may_link` holds, of all pairs. What two profiles have in common
    is summed up level by level of their counts, as products of matrices; once the levels above leave few pairs room, these
    are looked at one by one."""
    num, den = at_least.numerator, at_least.numerator + at_least.denominator
    need = (n[:, None] + m[None, :]) * num
    open_, room = np.minimum(n[:, None], m[None, :]) * den >= need, np.zeros(need.shape, np.float32)
    for level in range(1, LEVELS + 1):
        if np.count_nonzero(open_) * 16 <= open_.size:
            break
        room += (mine >= level).astype(np.float32) @ (theirs >= level).astype(np.float32).T
        above = np.minimum(*np.ix_(*(np.maximum(side - level, 0).sum(1, dtype=np.int64) for side in (mine, theirs))))
        open_ &= (room.astype(np.int64) + above) * den >= need
    left, right = np.nonzero(open_)
    step, good = max(1, PAIR_VALUES // mine.shape[1]), np.zeros(len(left), bool)
    for at in range(0, len(left), step):
        i, j = left[at:at + step], right[at:at + step]
        good[at:at + step] = may_link(mine[i], theirs[j], n[i], m[j], at_least)
    return left[good], right[good]


def _one_text(rows: DataFrame) -> DataFrame:
    """One row per id: that whose text has the least hash."""
    return rows.groupBy("id").agg(F.min_by("text_content", F.xxhash64("text_content")).alias("text_content"))


def _likely(pairs: DataFrame, nodes: DataFrame, at_least: Fraction, by: str) -> DataFrame:
    """The pairs whose sizes and profiles (column ``by``) leave room for the similarity."""
    kind = pairs.schema["id"].dataType.simpleString()
    theirs = nodes.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col(by).alias("theirs"))
    both = pairs.join(nodes.select("id", "n", F.col(by).alias("mine")), "id").join(theirs, "hub")
    both = both.filter(F.least("n", "m") * at_least.denominator >= F.greatest("n", "m") * at_least.numerator).select("hub", "id", "n", "mine", "m", "theirs")

    def step(batch):
        n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        keep = np.zeros(len(n), bool)
        mine, theirs = batch.column(3).to_pylist(), batch.column(5).to_pylist()
        short = np.array([len(p) == len(q) == FEWEST_FOLDS // 2 for p, q in zip(mine, theirs)], bool)
        if short.any():  # most are, and of one width
            sides = (profiles(pa.array([v for v, s in zip(side, short) if s], pa.binary()), by) for side in (mine, theirs))
            keep[short] = may_link(*sides, n[short], m[short], at_least)
        for k in np.flatnonzero(~short):
            two = profiles(pa.array([mine[k], theirs[k]], pa.binary()), by)
            keep[k] = may_link(two[0], two[1], n[k], m[k], at_least)
        yield pa.record_batch([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["hub", "id"])

    return on_bytes(both, step, f"hub {kind}, id {kind}")


def _around_hubs(members: DataFrame, nodes: DataFrame, at_least: Fraction) -> DataFrame:
    """``hub, id``: pairs of members of one hub and ``sign`` that are in different components (``part``) and whose folds
    leave room. ``members``: ``hub, sign, id, part``. A hub with one other member has no pair that it was not itself in.

    A hub's members are dealt out to blocks, and each two blocks meet in a task of their own: a task holds about two
    blocks, whatever the number of members."""
    kind = members.schema["id"].dataType.simpleString()
    sizes = members.groupBy("hub", "sign").agg(F.count(F.lit(1)).alias("members"), (F.min("part") != F.max("part")).alias("open")).filter("open and members > 2").select(
        "hub", "sign", F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("n_blocks"))
    placed = members.join(sizes, ["hub", "sign"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    placed = placed.withColumn("o", other).select("hub", "sign", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "part")
    key = ["hub", "sign", "i", "j"]
    placed = placed.join(nodes.select("id", "n", "fold"), "id").select(*key, "block", "id", "part", "n", "fold")
    placed = placed.repartition(*key).sortWithinPartitions(*key)

    def small_groups(rows: pa.Table, start: np.ndarray, size: np.ndarray):
        """Places of the pairs within groups of few members, all with folds of the least width."""
        first = np.concatenate([np.repeat(s + np.arange(k), np.arange(k - 1, -1, -1)) for s, k in zip(start, size)])
        second = np.concatenate([s + np.concatenate([np.arange(i + 1, k) for i in range(k)]) for s, k in zip(start, size)]).astype(np.int64)
        n, part = rows.column("n").to_numpy(), rows.column("part").to_numpy()
        apart = (part[first] != part[second]) & (np.minimum(n[first], n[second]) * at_least.denominator >= np.maximum(n[first], n[second]) * at_least.numerator)
        first, second = first[apart], second[apart]
        used, at = np.unique(np.concatenate([first, second]), return_inverse=True)
        if not len(used):
            return first, second
        held, (a, b) = profiles(rows.column("fold").take(pa.array(used)), "fold"), np.split(at, 2)
        step, good = PAIR_VALUES // held.shape[1], np.zeros(len(first), bool)
        for k in range(0, len(first), step):
            own = slice(k, k + step)
            good[own] = may_link(held[a[own]], held[b[own]], n[first[own]], n[second[own]], at_least)
        return first[good], second[good]

    def one_group(rows: pa.Table):
        n, block = rows.column("n").to_numpy(), rows.column("block").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        _, part = np.unique(rows.column("part").to_numpy(), return_inverse=True)
        left, right = [], []
        if len(n) > 1 and part.max():
            held = profiles(rows.column("fold"), "fold")
            # Each pair once: the second after the first within a block, the second block's against the first's.
            mine, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
            for at in range(0, len(mine), TILE_MEMBERS):
                a = mine[at:at + TILE_MEMBERS]
                b = theirs[at:] if i == j else theirs
                x, y = likely_pairs(held[a], held[b], n[a], n[b], at_least)
                x, y = a[x], b[y]
                good = (part[x] != part[y]) & ((x < y) if i == j else True)
                left.append(x[good])
                right.append(y[good])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def pairs_of(rows: pa.Table, starts: np.ndarray):
        """Of whole groups, which begin at ``starts``."""
        rows = rows.combine_chunks()
        size, ids = np.diff(np.append(starts, rows.num_rows)), rows.column("id").combine_chunks()
        short = np.minimum.reduceat(pc.binary_length(rows.column("fold")).to_numpy() == FEWEST_FOLDS // 2, starts)
        small = (size <= SMALL_GROUP) & short & (np.minimum.reduceat((rows.column("i").to_numpy() == rows.column("j").to_numpy()), starts))
        found = [small_groups(rows, starts[small], size[small])] if small.any() else []
        for s, k in zip(starts[~small], size[~small]):
            x, y = one_group(rows.slice(int(s), int(k)))
            found.append((x + s, y + s))
        x, y = (np.concatenate(side) for side in zip(*found))
        if len(x):
            yield pa.record_batch([ids.take(pa.array(side)) for side in (x, y)], ["hub", "id"])

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            kept = pa.concat_tables([kept, own]) if kept is not None else own
            values = [kept.column(c).to_numpy() for c in key]
            starts = np.flatnonzero(np.append(True, np.logical_or.reduce([v[1:] != v[:-1] for v in values])))
            if len(starts) > 1:  # the last group may go on
                yield from pairs_of(kept.slice(0, int(starts[-1])), starts[:-1])
                kept = kept.slice(int(starts[-1]))
        if kept is not None:
            yield from pairs_of(kept, np.zeros(1, np.int64))

    return placed.mapInArrow(run, f"hub {kind}, id {kind}")


def _compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``hub, id, common, either``: sizes of intersection and union of the shingle sets of pairs of rows."""
    # The ids have no size bound: they are never broadcast, so that the plan is one at every size.
    texts = _one_text(texts.join(pairs.select(F.explode(F.array("hub", "id")).alias("id")).distinct().hint("merge"), "id", "left_semi"))
    a = texts.select(F.col("id").alias("hub"), F.col("text_content").alias("hub_text"))
    both = pairs.join(texts.select("id", "text_content"), "id").join(a, "hub").select("hub", "id", "hub_text", "text_content")
    kind = pairs.schema["id"].dataType.simpleString()

    def step(batch):
        common, either = [], []
        for hub, mine, theirs in zip(batch.column(0).to_pylist(), row_shingles(batch.column(2), size), row_shingles(batch.column(3), size)):
            n = len(np.intersect1d(mine, theirs, assume_unique=True))
            common.append(n)
            either.append(len(mine) + len(theirs) - n)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(either, pa.int64())], ["hub", "id", "common", "either"])

    return on_bytes(both, step, f"hub {kind}, id {kind}, common bigint, either bigint")


def near_duplicates(
    analyses: DataFrame, id: str = "id", text: str = "text_content", words: int = SHINGLE_WORDS, at_least: Fraction = SIMILARITY,
    parts: int = PARTS, left_out: int = LEFT_OUT,
) -> DataFrame:
    """Links text analyses whose sets of word shingles (A-Z read as a-z) have a Jaccard similarity of ``at_least``.

    ``analyses``: ``id`` (any orderable type) and ``text_content``; other columns are not read. Returns one row per row:
    ``id, n_shingles, component_id``, the smallest id that can be reached over links, itself included. A text with fewer
    words than a shingle is one shingle; a text without words, or null, has none and is linked with nothing. Rows that
    repeat an id with different texts count as one node. A null id is linked with nothing. An empty table gives an
    empty result.

    Steps. Rows with one shingle set are a class, named by its least id. Every row's PartEnum signatures go to the
    tasks of their values; within one, rows meet a hub rather than each other. Hubs and rows are replaced by their
    classes. Pairs whose sizes or profiles (counts of shingles by part of the domain) leave no room for the similarity
    are passed over: first by short profiles, which can go with every pair, then by whole ones.
    The others are compared exactly. Two rows that met at one hub and are not in one component yet may still be linked:
    their short profiles are held against each other in blocks of a hub's members, and the pairs that are left go the
    same way. Of light signatures, which many rows have that nothing else links, the members are those of the signature. No link between different components is left out, and within one none more is sought. Texts are
    read again for the pairs that are compared, and stored nowhere."""
    rows = analyses.select(F.col(id).alias("id"), F.col(text).alias("text_content"))
    scheme = PartEnum(at_least, parts, left_out)
    sets = settle(_classes(rows, words))
    named = sets.filter("id is not null and like is not null")
    least = named.groupBy("like").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    cls = join_back(named.select("id", "like"), least, ["like"], "id").select("id", F.coalesce("cls", "id").alias("cls"))
    cls = settle(cls.groupBy("id").agg(F.min("cls").alias("cls")))
    signed = _signatures(rows.filter("id is not null"), words, scheme).repartition("sign").sortWithinPartitions("sign")
    met = settle(_stars(signed).filter("hub <> id").distinct())
    of_id, of_hub = cls.select("id", F.col("cls").alias("c")), cls.select(F.col("id").alias("hub"), F.col("cls").alias("h"))
    pairs = settle(met.join(of_id, "id").join(of_hub, "hub").select(F.col("h").alias("hub"), F.col("c").alias("id"), "sign").filter("hub <> id").distinct())
    forget(met)
    # Profiles go with the sets. Only ids that come more than once are grouped, so others' profiles are not shuffled.
    twice = settle(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    one = F.min_by(F.struct("n_shingles", "fold", "profile"), "h").alias("r")
    again = named.join(twice, "id", "left_semi").groupBy("id").agg(one).select("id", "r.*")
    nodes = named.join(twice, "id", "left_anti").select("id", "n_shingles", "fold", "profile").unionByName(again).withColumnRenamed("n_shingles", "n")
    # One order for each pair: (a, b) and (b, a) are compared once.
    ordered = lambda p: p.select(F.least("hub", "id").alias("hub"), F.greatest("hub", "id").alias("id")).distinct()
    linked = F.col("common") * at_least.denominator >= F.col("either") * at_least.numerator
    likely = settle(_likely(settle(_likely(ordered(pairs), nodes, at_least, "fold"), FOLD_ROWS), nodes, at_least, "profile"), PAIR_ROWS)
    first = settle(_compared(likely, rows, words).filter(linked), PAIR_ROWS)
    known = settle(components(first, "hub", "id"))

    members = pairs.unionByName(pairs.select("hub", F.col("hub").alias("id"), "sign")).distinct()
    members = members.join(known.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    rest = settle(ordered(_around_hubs(settle(members), nodes, at_least)).join(likely, ["hub", "id"], "left_anti"))
    rest = settle(_likely(rest, nodes, at_least, "profile"), PAIR_ROWS)
    forget(pairs)
    second = settle(_compared(rest, rows, words).filter(linked), PAIR_ROWS)
    whole = components(first.unionByName(second), "hub", "id")
    groups = cls.join(whole.select(F.col("node").alias("cls"), F.col("component").alias("c")), "cls", "left").select("id", F.coalesce("c", "cls").alias("component_id"))
    return sets.select("id", "n_shingles").join(groups, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
