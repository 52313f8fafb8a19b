"""Toxicity of texts by a classifier of sentences and word densities whose scores must not hang on which group is named."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import LONG_WORD, as_bytes, blocks, hash_tables, mix, on_bytes, settle

# ---------------------------------------------------------------------------------------- Fixed values
BITS = 20                 # of a feature's bucket
PREFIXES = (4, 5, 6, 7)   # bytes of a longer word that are a feature of their own: endings differ, stems stay
PER = 100.0               # words to which a text's densities are related
#: About so many labelled rows are learned from, spread evenly over all of them by a hash of the id; longer ones than
#: ``BYTES_LEARNED`` are not among them. Scores read texts of any length.
ROWS_LEARNED, BYTES_LEARNED = 4_000, 1 << 14
PASSES, FEWEST_STEPS, BATCH, RATE, SPARSE = 15, 1_000, 64, 0.2, 3e-4
FEWEST_ROWS = 3           # in which a feature must stand to get a weight
CAUTION = 1e-3            # squared gradient that a weight has seen before the first, so rare features move little
COUNTERFACTUAL = 1.0      # weight of the squared change of a sentence's score under a swap
SHIFTS = (1, 2)           # a term is swapped for the next and the one after the next of its group
THRESHOLD = 0.3
SENTENCE_ENDS = b".!?\n"
#: Terms that may stand for one another in a sentence, by language, number and part of speech.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("mothers", "fathers"), ("mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("africans", "asians", "arabs", "europeans", "americans"), ("african", "arab", "european", "american"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"), ("gays", "lesbians", "heterosexuals"),
    ("immigrants", "refugees", "foreigners", "citizens"), ("immigrant", "refugee", "foreigner", "citizen"), ("disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("musulman", "chrétien", "juif"), ("noirs", "blancs", "arabes"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"), ("homosexuels", "hétérosexuels"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("schwarze", "weiße", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"), ("schwule", "lesben"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"), ("homosexuales", "heterosexuales"),
)
# ---------------------------------------------------------------------------------------------------

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
_ENDS = np.zeros(256, bool)
_ENDS[list(SENTENCE_ENDS)] = True
_SENTENCE = re.compile(r"[^.!?\n]+")
_NEXT = [{t: group[(k + s) % len(group)] for group in IDENTITY_TERMS for k, t in enumerate(group) if group[(k + s) % len(group)] != t} for s in SHIFTS]
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(set().union(*IDENTITY_TERMS), key=lambda t: (-len(t), t))) + r")(?!\w)")
_FOLD = {i: i + 32 for i in range(65, 91)}


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of rows: the buckets of all features, the sentence of each, each sentence's row and each row's number
    of words. Sentences end at ``SENTENCE_ENDS``. Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z
    read as a-z; their features are the word and, of longer words, the ``PREFIXES``."""
    edges = np.unique(np.concatenate([at, np.flatnonzero(_ENDS[data]) + 1]))
    row = np.searchsorted(at, edges[:-1], "right") - 1
    plain = _PLAIN[data]
    inside = plain != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = edges[:-1][edges[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), row, np.zeros(len(at) - 1, np.int64)
    letters, places, _ = hash_tables(True)
    place = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    values = np.where(inside[start[0]:], letters[plain[start[0]:]] * places[np.minimum(place, LONG_WORD - 1)], np.uint64(0))
    length = np.add.reduceat(inside[start[0]:].astype(np.int64), start - start[0])
    sentence = np.searchsorted(edges, start, "right") - 1
    shift = np.uint64(64 - BITS)
    found, of = [mix(np.add.reduceat(values, start - start[0])) >> shift], [sentence]
    for k in PREFIXES:
        longer = length > k
        cut = np.add.reduceat(np.where(place < k, values, np.uint64(0)), start - start[0])[longer]
        found.append(mix(cut + np.uint64(k)) >> shift)
        of.append(sentence[longer])
    return np.concatenate(found).astype(np.int64), np.concatenate(of), row, np.bincount(row[sentence], minlength=len(at) - 1)


@dataclass
class ToxicityModel:
    """A bias and two weights per bucket, most of them 0: in the worst sentence, and by density. Of fixed size."""
    bias: float
    worst: np.ndarray
    density: np.ndarray

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of a block. A sentence has the sum of the weights of its distinct features; the worst one
        speaks for the row, beside the mean over its words of their features' densities."""
        feature, of, row, words = features(data, at)
        some = self.worst[feature] != 0
        key = np.unique(of[some] << BITS | feature[some])
        margins = np.bincount(key >> BITS, self.worst[key & ((1 << BITS) - 1)], len(row))
        worst = np.full(len(at) - 1, -np.inf)
        np.maximum.at(worst, row, margins)
        worst[~np.isfinite(worst)] = 0  # a text without a byte
        dense = np.bincount(row[of], self.density[feature], len(at) - 1) * PER / np.maximum(words, 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + worst + dense, -40, 40)))


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """Each sentence that names a group, A-Z read as a-z, beside itself with all terms swapped, for every shift."""
    out = []
    for sentence in _SENTENCE.findall((text or "").translate(_FOLD)) if _TERM.search((text or "").translate(_FOLD)) else []:
        if _TERM.search(sentence):
            swapped = {_TERM.sub(lambda m: other.get(m[0], m[0]), sentence) for other in _NEXT}
            out += [(sentence, other) for other in sorted(swapped - {sentence})]
    return out


@dataclass
class Bag:
    """Learned rows: the buckets of all features and where each row's begin; distinct ones by sentence, where sentences
    begin in them and rows in the sentences; what differs between a sentence and its counterfactual, +1 for the one
    and -1 for the other, where pairs begin in it and rows in the pairs."""
    feature: np.ndarray
    row: np.ndarray
    words: np.ndarray
    distinct: np.ndarray
    sentence: np.ndarray
    sentence_row: np.ndarray
    pair_feature: np.ndarray
    pair_sign: np.ndarray
    pair: np.ndarray
    pair_row: np.ndarray


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    return np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())


def _ends(sizes) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


class _Weights:
    """Per-weight rates, and a pull to 0 that a weight must outweigh."""

    def __init__(self, n: int):
        self.w, self.seen = np.zeros(n), np.full(n, CAUTION)

    def step(self, feature: np.ndarray, value: np.ndarray) -> None:
        g = np.bincount(feature, value, len(self.w))
        touched = np.flatnonzero(g)
        g = g[touched]
        self.seen[touched] += g * g
        rate = RATE / np.sqrt(self.seen[touched])
        moved = self.w[touched] - rate * g
        self.w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSE, 0)


def _kept(feature: np.ndarray, begin: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that have a place, as places, where runs of them begin now, and which of the old ones they are."""
    stay = place[feature] >= 0
    return place[feature[stay]], np.append(0, np.cumsum(stay))[begin], stay


def learn(bag: Bag, labels: np.ndarray, seed: int = 1, counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    """Logistic loss of each row's score plus ``counterfactual`` times the squared change of both of a sentence's scores
    under each swap, by mini-batches.

    The worst sentences share a row's gradient by the exponentials of their scores. Features of fewer than
    ``FEWEST_ROWS`` rows get no weight. Without both labels the model answers the only one's side (or one half)."""
    rng, n = np.random.default_rng(seed), len(labels)
    share = (labels.sum() + 1) / (n + 2)
    bias, seen = float(np.log(share / (1 - share))), CAUTION
    key = np.unique(np.repeat(np.arange(n), np.diff(bag.row)) << BITS | bag.feature)
    usable = np.flatnonzero(np.bincount(key & ((1 << BITS) - 1), minlength=1 << BITS) >= FEWEST_ROWS)
    place = np.full(1 << BITS, -1, np.int32)
    place[usable] = np.arange(len(usable), dtype=np.int32)
    del key
    features_, row_begin, _ = _kept(bag.feature, bag.row, place)
    distinct_, sentence_begin, _ = _kept(bag.distinct, bag.sentence, place)
    pair_feature, pair_begin, stay = _kept(bag.pair_feature, bag.pair, place)
    pair_sign = bag.pair_sign[stay]
    worst, dense = _Weights(len(usable)), _Weights(len(usable))
    passes = max(PASSES, -(-FEWEST_STEPS * BATCH // max(1, n)))  # few rows are read more often
    for _ in range(passes if len(set(labels.tolist())) > 1 else 0):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k:k + BATCH]
            own = _spans(bag.sentence_row[rows], bag.sentence_row[rows + 1])
            row = np.repeat(np.arange(len(rows)), bag.sentence_row[rows + 1] - bag.sentence_row[rows])
            distinct = distinct_[_spans(sentence_begin[own], sentence_begin[own + 1])]
            of = np.repeat(np.arange(len(own)), sentence_begin[own + 1] - sentence_begin[own])
            m = np.bincount(of, worst.w[distinct], len(own))
            top = np.full(len(rows), -np.inf)
            np.maximum.at(top, row, m)
            a = np.exp(m - top[row])
            a /= np.bincount(row, a, len(rows))[row]
            whole = features_[_spans(row_begin[rows], row_begin[rows + 1])]
            whole_row = np.repeat(np.arange(len(rows)), row_begin[rows + 1] - row_begin[rows])
            per = PER / np.maximum(bag.words[rows], 1)
            margin = bias + np.bincount(row, a * m, len(rows)) + np.bincount(whole_row, dense.w[whole], len(rows)) * per
            off = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[rows]) / len(rows)
            pairs = _spans(bag.pair_row[rows], bag.pair_row[rows + 1])
            for weights, feature, value in ((worst, distinct, (off[row] * a)[of]), (dense, whole, (off * per)[whole_row])):
                if len(pairs) and counterfactual:
                    places = _spans(pair_begin[pairs], pair_begin[pairs + 1])
                    which = np.repeat(np.arange(len(pairs)), pair_begin[pairs + 1] - pair_begin[pairs])
                    f, sign = pair_feature[places], pair_sign[places]
                    change = np.bincount(which, weights.w[f] * sign, len(pairs))
                    feature, value = np.append(feature, f), np.append(value, 2 * counterfactual * (change / len(pairs))[which] * sign)
                weights.step(feature, value)
            gb = float(off.sum())
            seen += gb * gb
            bias -= RATE * gb / seen ** 0.5
    model = ToxicityModel(bias, np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32))
    model.worst[usable], model.density[usable] = worst.w, dense.w
    return model


def _bags(column: pa.Array):
    """Per row: buckets of all features sentence by sentence, how many each sentence has, the number of words; what
    differs in its pairs (-1 - bucket for the counterfactual's side), how much each pair has."""
    data, at = as_bytes(column)
    texts = column.to_pylist()
    for first, last in blocks(at):
        feature, of, row, words = features(data[at[first]:at[last]], at[first:last + 1] - at[first])
        order = np.argsort(of, kind="stable")
        feature, sizes = feature[order], np.bincount(of, minlength=len(row))
        begin = _ends(sizes)
        for i in range(last - first):
            a, b = np.searchsorted(row, [i, i + 1])
            pairs = counterfactuals(texts[first + i])
            differ = []
            if pairs:
                raw = [t.encode() for pair in pairs for t in pair]
                f, o, r, _ = features(np.frombuffer(b"".join(raw), np.uint8), _ends([len(t) for t in raw]))
                sides = [np.unique(f[r[o] == j]) for j in range(len(raw))]
                differ = [np.append(np.setdiff1d(x, y), -1 - np.setdiff1d(y, x)) for x, y in zip(sides[::2], sides[1::2])]
            yield feature[begin[a]:begin[b]], sizes[a:b][sizes[a:b] > 0], int(words[i]), np.concatenate([np.zeros(0, int), *differ]), [len(d) for d in differ]


def fit_toxicity(
    results: DataFrame, labels: DataFrame, id: str = "id", text: str = "snippet", label: str = "label", rows_learned: int = ROWS_LEARNED,
    counterfactual: float = COUNTERFACTUAL,
) -> ToxicityModel:
    """Learns from labelled search results. ``labels``: ``id, label`` (0 or 1; null labels are not read; of labels that
    repeat an id the greater counts). Text alone is an input.

    About ``rows_learned`` labels are taken, and of their rows those of at most ``BYTES_LEARNED`` bytes: what comes to
    the driver has a size that does not grow with the tables. Each sentence of a learned row that names a group also
    stands with its identity terms swapped, and the two should score alike."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    sample = settle(known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < 1_000_003 * min(1.0, rows_learned / max(1, n))))
    rows = results.select(F.col(id).alias("id"), F.col(text).alias("snippet")).filter(F.coalesce(F.octet_length("snippet"), F.lit(0)) <= BYTES_LEARNED)
    rows = rows.join(sample, "id").select(F.xxhash64("id").alias("order"), "label", "snippet")

    def step(batch):
        feature, sizes, words, signed, pairs = zip(*_bags(batch.column(2)))
        lists = [pa.array([np.asarray(v, np.int32) for v in c], pa.list_(pa.int32())) for c in (feature, sizes, signed, pairs)]
        yield pa.record_batch([batch.column(0), batch.column(1), *lists, pa.array(words, pa.int64())], ["order", "label", "feature", "sizes", "signed", "pairs", "words"])

    got = on_bytes(rows, step, "order bigint, label int, feature array<int>, sizes array<int>, signed array<int>, pairs array<int>, words bigint").toArrow().combine_chunks()
    count = lambda c: pc.list_value_length(got.column(c)).to_numpy().astype(np.int64)
    totals = [np.add.reduceat(np.append(pc.list_flatten(got.column("feature")).to_numpy(), 0).astype(np.int64), np.minimum(_ends(count("feature"))[:-1], count("feature").sum()))] if got.num_rows else []
    keys = [*totals, count("feature"), *(got.column(c).to_numpy() for c in ("label", "order"))]
    got = got.take(pa.array(np.lexsort(keys))) if got.num_rows else got  # in one order, whichever task was ready first
    flat = lambda c: pc.list_flatten(got.column(c)).to_numpy().astype(np.int32)
    feature, sizes, signed = flat("feature"), flat("sizes"), flat("signed")
    key = np.unique(np.repeat(np.arange(len(sizes)), sizes) << BITS | feature)
    bag = Bag(
        feature, _ends(count("feature")), got.column("words").to_numpy(), (key & ((1 << BITS) - 1)).astype(np.int32), _ends(np.bincount(key >> BITS, minlength=len(sizes))),
        _ends(count("sizes")), np.where(signed < 0, -1 - signed, signed), np.where(signed < 0, -1.0, 1.0), _ends(flat("pairs")), _ends(count("pairs")),
    )
    del key
    return learn(bag, got.column("label").to_numpy().astype(float), counterfactual=counterfactual)


def score_toxicity(results: DataFrame, model: ToxicityModel, id: str = "id", text: str = "snippet") -> DataFrame:
    """Scores each search result's whole text: ``id, score`` (0 to 1, higher is more toxic), ``predicted`` (1 from
    ``THRESHOLD``).

    ``results``: ``id, snippet``; other columns are not read. Its worst sentence counts whatever the text's length,
    beside what its words are on average. A null text, like an empty one, scores what one without a known feature does. Rows
    that repeat are scored each; an empty table gives an empty result. No shuffle."""
    shared = results.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        data, at = as_bytes(batch.column(1))
        scores = [shared.value.score(data[at[a]:at[b]], at[a:b + 1] - at[a]) for a, b in blocks(at)]
        yield pa.record_batch([batch.column(0), pa.array(np.concatenate(scores))], ["id", "score"])

    rows = results.select(F.col(id).alias("id"), F.col(text).alias("snippet"))
    out = on_bytes(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
