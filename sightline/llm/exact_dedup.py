"""Exact duplicates of submitted texts by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_bytes, join_back, on_bytes, settle

# ---------------------------------------------------------------------------------------- Fixed values
CHUNK_LEAST, CHUNK_USUAL, CHUNK_MOST = 256, 1024, 16_384   # bytes
WINDOW = 16                                                # bytes whose rolling hash decides a cut
# ---------------------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WEIGHTS = np.random.default_rng(7).integers(1, 2**32, 256, np.uint32)


def folded(text):
    """A text column as it is compared: null as empty, A-Z as a-z."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cuts(text: np.ndarray, usual: int = CHUNK_USUAL) -> list[int]:
    """Ends of the chunks of one folded text. A cut depends on the last ``WINDOW`` bytes and on the cut before it, so
    equal texts have equal cuts, and an insertion changes only the chunks around it."""
    n = len(text)
    if n <= CHUNK_LEAST:
        return [n] if n else []
    h, width, factor = _WEIGHTS[text], 1, 0x9E3779B1
    while width < WINDOW:
        h[width:] = h[width:] + h[:-width] * np.uint32(factor)
        factor, width = factor * factor & 0xFFFFFFFF, width * 2
    ends, last = [], 0
    for end in (np.flatnonzero(h[WINDOW:] >> np.uint32(16) & np.uint32(usual - 1) == 0) + WINDOW + 1).tolist():
        while end - last > CHUNK_MOST:
            last += CHUNK_MOST
            ends.append(last)
        if end - last >= CHUNK_LEAST:
            last = end
            ends.append(last)
    while n - last > CHUNK_MOST:
        last += CHUNK_MOST
        ends.append(last)
    return ends + [n] if last < n else ends


def _chunks(batch: pa.RecordBatch, usual: int):
    """Of each row: its folded text and the chunks of it."""
    with np.errstate(over="ignore"):
        data, at = as_bytes(batch.column(1))
        for i in range(batch.num_rows):
            folded = _FOLD[data[at[i]:at[i + 1]]]
            text, last, parts = folded.tobytes(), 0, []
            for end in cuts(folded, usual):
                parts.append(text[last:end])
                last = end
            yield text, parts


def chunk_recipes(analyses: DataFrame, id: str = "id", text: str = "text_content", usual: int = CHUNK_USUAL) -> DataFrame:
    """``id, media_hash, recipe``: SHA-256 of the folded text and the ordered 64-bit names of its chunks. About one
    hundredth of the text's bytes; the text itself moves nowhere."""
    def step(batch):
        hashes, recipes = [], []
        for whole, parts in _chunks(batch, usual):
            hashes.append(hashlib.sha256(whole).hexdigest())
            recipes.append(np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64).view(np.int64))
        yield pa.record_batch([batch.column(0), pa.array(hashes, pa.string()), pa.array(recipes, pa.list_(pa.int64()))], ["id", "media_hash", "recipe"])

    rows = analyses.select(F.col(id).alias("id"), F.col(text).alias("text_content"))
    return on_bytes(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, media_hash string, recipe array<bigint>")


def contested_chunks(analyses: DataFrame, text: str = "text_content", usual: int = CHUNK_USUAL) -> DataFrame:
    """``chunk``: names that stand for two or more different chunk contents. Each different chunk is moved once per
    task and compared by its bytes; a name that is not returned is verified."""
    def step(batch):
        once = {part for _, parts in _chunks(batch, usual) for part in parts}
        for group in _limited(once):
            names = np.array([xxhash.xxh3_64_intdigest(p) for p in group], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(names), pa.array(group, pa.binary())], ["chunk", "content"])

    rows = analyses.select(F.lit(0).alias("none"), F.col(text).alias("text_content"))
    chunks = on_bytes(rows, step, "chunk bigint, content binary").distinct()
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk")


def _limited(parts: set[bytes], most: int = 8 << 20):
    """Lists of at most about ``most`` bytes."""
    group, size = [], 0
    for p in parts:
        group.append(p)
        size += len(p)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def dedupe_texts(analyses: DataFrame, id: str = "id", text: str = "text_content", usual: int = CHUNK_USUAL) -> DataFrame:
    """Finds equal texts among text analyses (A-Z and a-z are one letter) and says which row of each stays.

    ``analyses``: one row per submitted text, ``id`` (any orderable type) and ``text_content``; other columns are not
    read and may have any name. Returns one row per row, ``id, keep_id, group_size, kept, media_hash, n_chunks``:
    the largest id of equal texts stays.

    Method: texts are cut into content-defined chunks; chunk contents are compared once each, which makes their names
    verified identifiers; two texts are equal when their ordered lists of identifiers are. Lists that hold a contested
    name (two contents with one 64-bit name) are told apart by the whole text's SHA-256 as well.

    A null text counts as empty, and all empty texts are equal (an empty list). Rows that repeat an id with an equal
    text are one group; if they are the largest id, all of them are kept. A row with a null id is kept only in a group
    without any other id. An empty table gives an empty result."""
    rows = settle(chunk_recipes(analyses, id, text, usual))
    held = rows.groupBy("recipe", "media_hash").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    contested = contested_chunks(analyses, text, usual)
    unsure = held.select("media_hash", F.explode(F.array_distinct("recipe")).alias("chunk")).join(contested, "chunk", "left_semi").select("media_hash").distinct()
    held = held.join(unsure.withColumn("unsure", F.lit(True)), "media_hash", "left")
    other = F.when(F.col("unsure"), F.col("media_hash")).otherwise("")
    groups = held.withColumn("other", other).groupBy("recipe", "other").agg(
        F.max("last").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("media_hash").alias("texts"),
    ).filter("group_size > 1").select(F.explode("texts").alias("media_hash"), "keep_id", "group_size")
    out = join_back(rows.select("id", "media_hash", F.size("recipe").alias("n_chunks")), groups, ["media_hash"], "id")
    keep, size = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1))
    return out.select("id", keep.alias("keep_id"), size.cast("bigint").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "media_hash", "n_chunks")
