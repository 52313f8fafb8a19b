"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_bytes, blocks, on_bytes

# ---------------------------------------------------------------------------------------- Fixed values
ORDERS = (1, 2, 3)             # characters of an n-gram
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: About so many labelled rows of each language are learned from, spread evenly over all of them by a hash of the id.
ROWS_PER_LANGUAGE = 4_000
UNKNOWN = "und"
#: A text is in its language's range if its mean log probability per n-gram is at most so many of the language's own
#: standard deviations below the language's own mean, and a second share, over the root of its characters, more.
RANGE, RANGE_SHORT = 1.2, 2.5
# ---------------------------------------------------------------------------------------------------

_EASY = re.compile(r"[A-Za-z]")
_NO_WORDS = re.compile(r"\S*[\d@/=]\S*")
_LETTERS = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_EASY.search(text) is not None or any(map(str.isalpha, text)))


def bucket_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, one text after the other, and where each text's begin. Every text
    is framed by blanks, and an n-gram never reaches into the next text."""
    framed = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(t) for t in framed], np.int64)
    start = np.concatenate(([0], np.cumsum(lengths)))
    out = np.empty((len(codes), len(ORDERS)), np.int32)
    h = np.zeros(len(codes), np.uint64)
    for k, n in enumerate(ORDERS):
        # h of n characters from here; a gram that would leave the text is read as the shorter one, in a bucket of its own.
        for j in range(ORDERS[k - 1] if k else 0, n):
            own = np.zeros(len(codes), np.uint64)
            own[:len(codes) - j] = codes[j:] + np.uint64(1)
            for i in range(1, j + 1):
                own[start[1:] - i] = 0
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ own * np.uint64(0xC2B2AE3D27D4EB4F)
        out[:, k] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int32) % BUCKETS
    return out.reshape(-1), start * len(ORDERS)


@dataclass
class LanguageModel:
    """``matrix``: log probability of each bucket in each language (float32, languages x buckets); bounded by the
    number of languages, whatever the number of texts. ``means``, ``spreads``: mean and standard deviation of the log
    probability of an n-gram of each language's own texts, each occurrence judged by all others."""
    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray
    means: np.ndarray
    spreads: np.ndarray

    def _logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text's n-grams in each language, and their number."""
        found, at = bucket_runs(texts)
        return np.stack([np.add.reduceat(row[found], at[:-1], dtype=np.float64) for row in self.matrix], 1), np.diff(at)

    def _margins(self, logs: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        off = (logs[np.arange(len(best)), best] / n - self.means[best]) / self.spreads[best]
        return off + RANGE + RANGE_SHORT / np.sqrt(n / len(ORDERS))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its posterior probability, and by how many standard deviations the text
        is inside the language's range. The sparse counts of a text are its n-gram buckets, in turn; their log
        probabilities are gathered and added up by text. A text that is outside is looked at again without numbers,
        addresses and signs, which are not of any language."""
        logs, n = self._logs(texts)
        sums = logs + self.priors
        best = sums.argmax(1)
        odds = np.exp(sums - sums.max(1, keepdims=True))
        margins = self._margins(logs, n, best)
        if len(out := np.flatnonzero(margins < 0)):
            bare = [" ".join(_LETTERS.findall(_NO_WORDS.sub(" ", texts[i]))) for i in out]
            margins[[i for i, b in zip(out, bare) if not b]] = 0  # nothing speaks against it
            if again := [(i, b) for i, b in zip(out, bare) if b]:
                at = np.array([i for i, _ in again])
                margins[at] = np.maximum(margins[at], self._margins(*self._logs([b for _, b in again]), best[at]))
        return [self.languages[b] for b in best], odds[np.arange(len(best)), best] / odds.sum(1), margins


def _text_blocks(column: pa.Array):
    _, at = as_bytes(column)
    for first, last in blocks(at, 1 << 18):
        yield first, column.slice(first, last - first).to_pylist()


def fit_languages(results: DataFrame, id: str = "id", text: str = "snippet", language: str = "language", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learns from the rows of ``results`` whose ``language`` is not null. Two small jobs: rows by language, then
    n-gram counts of the sample, summed by (language, bucket) on the executors. What comes to the driver is bounded by
    languages x buckets. Without labelled rows the model knows no language. Languages are few: a label set."""
    rows = results.select(F.col(id).alias("id"), F.col(text).alias("snippet"), F.col(language).alias("language")).filter("language is not null")
    sizes = {r["language"]: r["count"] for r in rows.groupBy("language").count().orderBy("language").collect()}
    if not sizes:
        return LanguageModel([], np.zeros(0), np.zeros((0, BUCKETS), np.float32), np.zeros(0), np.zeros(0))
    languages = sorted(sizes)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows_per_language / sizes[k])))])
    place = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    taken = rows.filter(F.pmod(F.xxhash64("id", "language"), F.lit(1_000_003)) < F.try_element_at(share, F.col("language")) * 1_000_003)
    taken = taken.select(F.try_element_at(place, F.col("language")).alias("place"), F.coalesce("snippet", F.lit("")).alias("snippet"))

    def step(batch):
        counts: dict[int, np.ndarray] = {}
        places = batch.column(0).to_numpy()
        for first, texts in _text_blocks(batch.column(1)):
            found, at = bucket_runs(texts)
            which = np.repeat(places[first:first + len(texts)], np.diff(at))
            for p in np.unique(which):
                counts[p] = counts.get(p, 0) + np.bincount(found[which == p], minlength=BUCKETS)
        for p, c in counts.items():
            there = np.flatnonzero(c)
            yield pa.record_batch([pa.array(np.full(len(there), p, np.int32)), pa.array(there.astype(np.int32)), pa.array(c[there].astype(np.int64))], ["place", "bucket", "n"])

    sums = on_bytes(taken, step, "place int, bucket int, n bigint").groupBy("place", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["place"].to_numpy(np.int64), sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy()
    seen = counts.sum(1, keepdims=True)
    share = counts / np.maximum(seen, 1)
    others = np.log((np.maximum(counts - 1, 0) + SMOOTHING) / (np.maximum(seen - 1, 0) + SMOOTHING * BUCKETS))
    means = (share * others).sum(1)
    spreads = np.sqrt((share * (others - means[:, None]) ** 2).sum(1))
    counts += SMOOTHING
    total = sum(sizes.values())
    matrix = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, np.log([sizes[k] / total for k in languages]), matrix, means, np.maximum(spreads, 0.1))


def identify(results: DataFrame, model: LanguageModel, id: str = "id", text: str = "snippet", keep_text: bool = False) -> DataFrame:
    """The language of each search result's text.

    ``results``: ``id, snippet``; other columns are not read. Returns one row per row: ``id, lang_pred, score`` (the
    posterior probability, which only compares the learned languages), ``margin`` (below 0: by its n-grams the text is
    in none of them). A text that is null or has no letter is ``und`` with score and margin 0, and so is every text if
    the model knows no language. Rows that repeat are answered each. ``keep_text`` hands the text on
    as ``snippet``. Whole texts; no shuffle."""
    shared = results.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        m = shared.value
        names, scores, margins = [], [], []
        for _, texts in _text_blocks(batch.column(1)):
            ask = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            own, own_score, own_margin = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if ask:
                found, p, margin = m.predict([texts[i] for i in ask])
                for i, f in zip(ask, found):
                    own[i] = f
                own_score[ask], own_margin[ask] = p, margin
            names += own
            scores.append(own_score)
            margins.append(own_margin)
        told = [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(margins))]
        yield pa.record_batch([batch.column(0), *told, *batch.columns[1:1 + keep_text]], ["id", "lang_pred", "score", "margin", "snippet"][:4 + keep_text])

    rows = results.select(F.col(id).alias("id"), F.col(text).alias("snippet"))
    return on_bytes(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, margin double" + ", snippet string" * keep_text)
