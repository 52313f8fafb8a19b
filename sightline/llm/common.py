"""What the operators share: settled tables, Arrow batches as bytes, word and shingle hashes, connected components."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import shared_folder

# ---------------------------------------------------------------------------------------- Fixed values
WORD = r"[^\x20\x09-\x0D]+"
GAP_BYTES = b" \t\n\x0b\x0c\r"
LONG_WORD = 4096          # bytes; longer words are hashed whole by xxh3
BLOCK_BYTES = 1 << 19     # documents are worked on in blocks of about this many bytes
HASH_SEED = 20240501
# ---------------------------------------------------------------------------------------------------


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def settle(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither recompute it nor depend on the
    executor that made it, and the optimizer knows its real size before it considers a broadcast. ``batch_rows``: of one
    Arrow batch, for steps whose rows are long; the session's own number holds again afterwards."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sightline-llm-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*settled: DataFrame) -> None:
    """Deletes settled tables that no later step reads."""
    for df in settled:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sightline-llm-" in folder:
                sc = df.sparkSession.sparkContext
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def on_bytes(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a step that takes one batch at a time."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying it, and where each row begins; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)), at


def blocks(at: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``limit`` bytes; a longer row stands alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.cache
def hash_tables(fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(HASH_SEED)
    letters, places = rng.integers(1, 2**64, 256, np.uint64), rng.integers(0, 2**64, LONG_WORD, np.uint64) | np.uint64(1)
    gap = np.zeros(256, bool)
    gap[list(GAP_BYTES)] = True
    letters[gap] = 0
    if fold:
        letters[65:91] = letters[97:123]
    return letters, places, gap


def word_hashes(data: np.ndarray, at: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a block of rows, and for each row the place of its first word (one more at the
    end). ``fold`` reads A-Z as a-z. ``data`` is the block's bytes, ``at`` where rows begin in it."""
    letters, places, gap = hash_tables(fold)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~gap[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < at[1:]]
    begins[rows] = inside[rows]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    lengths = np.diff(np.append(start, n))
    place = np.arange(start[0], n) - np.repeat(start, lengths)
    np.minimum(place, LONG_WORD - 1, out=place)
    values = letters[data[start[0]:]]
    values *= places[place]
    hashes = np.add.reduceat(values, start - start[0])
    for k in np.flatnonzero(lengths >= LONG_WORD):
        word = data[start[k]:start[k] + lengths[k]].tobytes()
        word = word[:len(word.rstrip(GAP_BYTES))]
        if len(word) >= LONG_WORD:
            hashes[k] = xxhash.xxh3_64_intdigest(word.lower() if fold else word)
    return mix(hashes), np.searchsorted(start, at)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of one row's word shingles; a row with fewer words is one shingle, without words none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    salts = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    if len(words) < size:
        return mix((words * salts[:len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    total = words[:len(words) - size + 1] * salts[0]
    for j in range(1, size):
        total += words[j:len(words) - size + 1 + j] * salts[j]
    return np.unique(mix(total))


def row_shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each row of a text column, A-Z read as a-z."""
    data, at = as_bytes(column)
    for first, last in blocks(at):
        words, places = word_hashes(data[at[first]:at[last]], at[first:last + 1] - at[first], True)
        for i in range(last - first):
            yield shingle_hashes(words[places[i]:places[i + 1]], size)


def join_back(many: DataFrame, few: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = 8) -> DataFrame:
    """Gives each row of ``many`` the row of ``few`` (one per key) that has its keys; null keys are equal.

    The few are repeated once per salt and the rows of a key dealt out over the salts by ``spread``, so a key that
    holds a third of all rows is no single task, whichever join the optimizer takes."""
    more = [c for c in few.columns if c not in keys]
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = few.select(*[F.col(k).alias(f"_few_{k}") for k in keys], *more, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_few_salt"))
    same = F.col("_salt") == F.col("_few_salt")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_few_{k}"))
    return left.join(right, same, how).select(*many.columns, *more)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every end of a link, the component being its smallest node.

    Alternating large and small stars: each round gives every node's larger, then smaller, neighbours to the least node
    it sees. Only minima cross between tasks; a hub is combined before the shuffle. Rounds grow with the logarithm of
    the longest chain, each is settled, and only a count and a checksum of the links come to the driver."""
    at = settle(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct())

    def seen(edges: DataFrame) -> tuple:
        r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    def star(edges: DataFrame) -> DataFrame:
        """Each (u, v): v hangs on u's least neighbour m, and u too where m is smaller."""
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        return edges.join(least, "u")

    before = seen(at)
    while before[0]:
        both = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v"), F.least("u", "m").alias("u")).filter("u < v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        small = star(down).select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").filter("u < v").distinct()
        at = settle(small)
        after = seen(at)
        if after == before:
            break
        before = after
    return at.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(at.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def file_bytes(spark: SparkSession, path: str):
    """A vocabulary file of a few MB, read on the driver and broadcast: executors need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
