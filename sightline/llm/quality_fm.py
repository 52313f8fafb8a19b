"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata of the text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_bytes, blocks, on_bytes, settle, word_hashes

# ---------------------------------------------------------------------------------------- Fixed values
BUCKETS = 1 << 12
FACTORS = 8
#: About so many labelled rows are learned from, spread evenly over all of them by a hash of the id.
ROWS_LEARNED = 6_000
PASSES, BATCH, RATE, DECAY = 12, 128, 0.05, 1e-5
STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "commonest_word", "capitals", "digits", "points", "symbols",
    "bars", "line_ends", "line_words", "beyond_ascii",
)
# ---------------------------------------------------------------------------------------------------

_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((range(65, 91), range(48, 58), b".,;:!?'\"()-", b"#*$%&<>@^~_=+\\/{}[]`", b"|", b"\n", range(0xC0, 0x100)), 1):
    _KINDS[list(_bytes)] = _kind


def features(column: pa.Array, most_rows: int = 64):
    """For runs of rows: the first row, hashed-word features (rows x ``BUCKETS``, damped counts of unit length) and the
    structure statistics (rows x ``STATISTICS``)."""
    data, at = as_bytes(column)
    for first, last in ((k, min(k + most_rows, b)) for a, b in blocks(at) for k in range(a, b, most_rows)):
        n, own = last - first, data[at[first]:at[last]]
        places = at[first:last + 1] - at[first]
        words, begins = word_hashes(own, places, True)
        row = np.repeat(np.arange(n), np.diff(begins))
        counts = np.bincount(row * BUCKETS + (words >> np.uint64(52)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
        size, n_words = np.diff(places).astype(float), np.diff(begins).astype(float)
        kinds = np.bincount(np.repeat(np.arange(n), np.diff(places)) * 8 + _KINDS[own], minlength=n * 8).reshape(n, 8)[:, 1:]
        some, some_words = np.maximum(size, 1)[:, None], np.maximum(n_words, 1)
        capitals, digits, points, symbols, bars, ends, wide = (kinds / some).T
        statistics = np.stack([
            np.log1p(size), np.log1p(n_words), size / some_words, (counts > 0).sum(1) / np.minimum(some_words, BUCKETS), counts.max(1) / some_words,
            capitals, digits, points, symbols, bars, ends, np.log1p(n_words / (kinds[:, 5] + 1)), wide,
        ], 1)
        np.log1p(counts, out=counts)
        counts /= np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-9)
        yield first, counts, statistics.astype(np.float32)


@dataclass
class QualityModel:
    """w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, and how statistics are standardised. Of fixed size."""
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def inputs(self, counts: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        return np.concatenate([counts, np.clip((statistics - self.mean) / self.spread, -4, 4) / 4], 1)

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linear in the inputs: the pairs' sum is half of (sum of v x)^2 - sum of (v x)^2, factor by factor."""
        summed = x @ self.factors
        pairs = 0.5 * ((summed * summed).sum(1) - (x * x) @ (self.factors * self.factors).sum(1))
        return self.bias + x @ self.weights + pairs, summed

    def score(self, counts: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.inputs(counts, statistics))[0].astype(float), -40, 40)))


def learn(counts: np.ndarray, statistics: np.ndarray, labels: np.ndarray, seed: int = 1) -> QualityModel:
    """Logistic loss by mini-batches with per-weight rates. Without both labels the model answers the only one's side
    (or one half)."""
    rng = np.random.default_rng(seed)
    n, d = len(labels), BUCKETS + len(STATISTICS)
    mean = statistics.mean(0) if n else np.zeros(len(STATISTICS), np.float32)
    spread = np.maximum(statistics.std(0), 1e-3) if n else np.ones(len(STATISTICS), np.float32)
    share = (labels.sum() + 1) / (n + 2)
    m = QualityModel(float(np.log(share / (1 - share))), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, FACTORS)).astype(np.float32), mean, spread)
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    seen_b, seen_w, seen_v = 1e-6, np.full(d, 1e-6, np.float32), np.full((d, FACTORS), 1e-6, np.float32)
    for _ in range(PASSES):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k:k + BATCH]
            x = m.inputs(counts[rows], statistics[rows])
            y, summed = m.margin(x)
            off = ((1 / (1 + np.exp(-np.clip(y, -40, 40))) - labels[rows]) / len(rows)).astype(np.float32)
            g = x.T @ off + DECAY * m.weights
            gv = x.T @ (off[:, None] * summed) - m.factors * ((x * x).T @ off)[:, None] + DECAY * m.factors
            gb = float(off.sum())
            seen_b, seen_w, seen_v = seen_b + gb * gb, seen_w + g * g, seen_v + gv * gv
            m.bias -= RATE * gb / seen_b ** 0.5
            m.weights -= RATE * g / np.sqrt(seen_w)
            m.factors -= RATE * gv / np.sqrt(seen_v)
    return m


def fit_quality(results: DataFrame, labels: DataFrame, id: str = "id", text: str = "snippet", label: str = "label", rows_learned: int = ROWS_LEARNED) -> QualityModel:
    """Learns from labelled search results. ``labels``: ``id, label`` (0 or 1; null labels are not read).

    About ``rows_learned`` labels are taken, so the sampled labels are a table of known size, and their rows' features
    (at most ``BUCKETS`` numbers a row) are what comes to the driver. Text alone is an input."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)").dropDuplicates(["id"])
    n = known.count()
    sample = settle(known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < 1_000_003 * min(1.0, rows_learned / max(1, n))))
    rows = results.select(F.col(id).alias("id"), F.col(text).alias("snippet")).join(sample, "id").select("label", "snippet")

    def step(batch):
        for first, counts, statistics in features(batch.column(1)):
            there = [np.flatnonzero(c).astype(np.int32) for c in counts]
            yield pa.record_batch([
                batch.column(0).slice(first, len(counts)), pa.array(there, pa.list_(pa.int32())),
                pa.array([c[i] for c, i in zip(counts, there)], pa.list_(pa.float32())), pa.array(list(statistics), pa.list_(pa.float32())),
            ], ["label", "at", "value", "statistics"])

    got = on_bytes(rows, step, "label int, at array<int>, value array<float>, statistics array<float>").toArrow()
    counts = np.zeros((got.num_rows, BUCKETS), np.float32)
    lists = got.column("at").combine_chunks()
    if got.num_rows:
        which = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
        counts[which, lists.flatten().to_numpy()] = got.column("value").combine_chunks().flatten().to_numpy()
    statistics = np.array(got.column("statistics").to_pylist(), np.float32).reshape(-1, len(STATISTICS))
    # In one order, whichever task was ready first.
    order = np.lexsort([*statistics.T[:4], got.column("label").to_numpy()]) if got.num_rows else np.zeros(0, int)
    return learn(counts[order], statistics[order], got.column("label").to_numpy().astype(np.float32)[order])


def score_quality(results: DataFrame, model: QualityModel, id: str = "id", text: str = "snippet") -> DataFrame:
    """Scores each search result's whole text: ``id, score`` (0 to 1, higher is better), ``predicted`` (1 from one half).

    ``results``: ``id, snippet``; other columns are not read. A null text is scored as an empty one, by its statistics;
    rows that repeat are scored each; an empty table gives an empty result. Work is linear in the inputs. No shuffle."""
    shared = results.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        scores = np.concatenate([shared.value.score(c, s) for _, c, s in features(batch.column(1))])
        yield pa.record_batch([batch.column(0), pa.array(scores)], ["id", "score"])

    rows = results.select(F.col(id).alias("id"), F.col(text).alias("snippet"))
    out = on_bytes(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
