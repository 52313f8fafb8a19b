"""Vector codes, hard negatives and toxicity against brute force, held-out labels and awkward records."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import hard_negatives, queries, toxicity, vector_codes
from sightline.llm.common import hash_tables, mix

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def stored(spark, n=700, dim=12, seed=1, hot=0):
    """Embeddings around a few centres, with copies; ``hot`` rows that repeat one vector; awkward rows at the end."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = (centres[rng.integers(0, 6, n)] + rng.normal(scale=0.4, size=(n, dim))) / 3
    x[n // 2:n // 2 + hot] = x[0]
    x[-20:] = x[:20]
    rows = [(i, v.tolist(), int(rng.integers(0, 4)) if i % 11 else None) for i, v in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [NAN] * dim, 1), (n + 3, [INF] * dim, 2), (n + 4, [None] * dim, 2), (n + 5, [0.5] * (dim + 4), 3),
             (n + 6, [1e30] * dim, 3), (n + 7, [0.0] * dim, 0)]
    df = spark.createDataFrame(rows, "media_hash bigint, embedding array<double>, ref_url int")
    return df.withColumns({c: F.lit(c) for c in ("id", "x", "label", "asked", "block", "code", "row", "windows", "found")}).withColumn("source", F.col("ref_url")).repartition(4)


def usable(df, label, dim, scale, most):
    out = []
    for r in df.select("media_hash", "embedding", label).collect():
        v = r["embedding"]
        if v and len(v) == dim and all(c is not None and np.isfinite(c) for c in v):
            out.append((r["media_hash"], r[label], np.clip(np.floor(np.array(v) * scale), -most, most).astype(np.int64)))
    return sorted(out, key=lambda r: r[0])


def lloyd(rows, entries, rounds):
    x = np.stack([r[2] for r in rows]).reshape(len(rows), 4, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((x[:, k, None] - books[k]) ** 2).sum(2).argmin(1) for k in range(4)], 1)
    for _ in range(rounds):
        at = near()
        for k in range(4):
            for e in np.unique(at[:, k]):
                own = x[at[:, k] == e, k]
                books[k, e] = own.sum(0) // len(own)
    at = near()
    return books, at, ((x - np.stack([books[k][at[:, k]] for k in range(4)], 1)) ** 2).sum((1, 2))


@pytest.mark.parametrize("entries,block", [(256, 4096), (37, 50), (1, 64)])
def test_codes_equal_brute_force(spark, monkeypatch, entries, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    df = stored(spark, hot=200)
    df = df.union(df.filter("media_hash = 3"))
    rows = usable(df, "source", 12, 1024, vector_codes.LARGEST)
    books, at, error = lloyd(rows, entries, vector_codes.ROUNDS)
    got = sorted(vector_codes.compress_vectors(df, entries=entries).collect(), key=lambda r: r["media_hash"])
    assert [(r["media_hash"], r["source"], r["code"], r["error"]) for r in got] == [(i, s, bytes(c.astype(np.uint8)).hex(), int(e)) for (i, s, _), c, e in zip(rows, at, error)]
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}
    for s in {r["source"] for r in got}:
        assert {r["label_error"] for r in got if r["source"] == s} == {int(sum(e for (_, t, _), e in zip(rows, error) if t == s))}


def test_two_trees_agree_with_all_distances():
    rng = np.random.default_rng(4)
    for n, k, d, spread in ((1, 1, 3, 5), (5, 9, 1, 2), (900, 64, 16, 400), (300, 255, 4, 3)):
        points, entries = rng.integers(-spread, spread, (n, d)), rng.integers(-spread, spread, (k, d))
        order = vector_codes.tree_order(points, vector_codes.LEAF)
        assert sorted(order) == list(range(n))
        (tree, names), = vector_codes.entry_trees(entries[None])
        found, sums, counts = vector_codes.assign(vector_codes.Tree.over(points[order], vector_codes.LEAF, True), tree, names)
        want = ((points[:, None] - entries) ** 2).sum(2).argmin(1)
        assert (found == want[order]).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[want == e].sum(0)).all() for e in range(k))


def test_a_tight_group_is_assigned_whole(monkeypatch):
    points = np.repeat([[0, 0], [1000, 1000]], 64, axis=0) + np.arange(128)[:, None] % 3
    order = vector_codes.tree_order(points, vector_codes.LEAF)
    tree = vector_codes.Tree.over(points[order], vector_codes.LEAF, True)
    tree.points = np.full_like(tree.points, 10**6)  # no leaf may be looked into
    (entries, names), = vector_codes.entry_trees(np.array([[[1, 1], [1001, 1001]]]))
    _, sums, counts = vector_codes.assign(tree, entries, names)
    assert counts.tolist() == [64, 64] and sums[0].tolist() == points[:64].sum(0).tolist()


def mined(rows, chosen, k=5, n=10):
    out = set()
    ids, x = np.array([r[0] for r in rows]), np.stack([r[2] for r in rows])
    for a, label, v in rows:
        if not chosen(a):
            continue
        score = x @ v
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != a]
        for p in [i for i in order if rows[i][1] == label][:k]:
            fits = [i for i in order if rows[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:n]
            out |= {(a, ids[p], r, ids[i], score[p], score[i]) for r, i in enumerate(fits, 1)}
    return out


@pytest.mark.parametrize("block,entries,hot", [(16_384, 16, 0), (60, 5, 250), (40, 16, 0)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, entries, hot):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 32)
    monkeypatch.setattr(hard_negatives.learn, "__defaults__", (entries,))
    df = stored(spark, seed=2, hot=hot)
    df = df.union(df.filter("media_hash in (7, 50)")).union(df.filter("media_hash = 9").withColumn("media_hash", F.lit(None)))
    seen = {}
    for r in usable(df.filter("media_hash is not null and ref_url is not null"), "ref_url", 12, 256, hard_negatives.LARGEST):
        seen.setdefault(r[0], r)
    rows = list(seen.values())
    got = hard_negatives.mine_negatives(df, F.col("media_hash") % 10 == 0).collect()
    want = mined(rows, lambda a: a % 10 == 0)
    assert len(got) == len(want) > 100
    assert {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got} == want


def test_cells_out_of_reach_are_not_visited(spark, monkeypatch):
    """Two far groups: an anchor of one never scores the other's rows for its positives."""
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 32)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.01 + 1, rng.normal(size=(300, 8)) * 0.01 - 1])
    books = hard_negatives.learn(np.floor(x * 256), 4)
    c1, d1, c2, d2 = books.place(np.floor(x * 256))
    import pyarrow as pa
    walk = hard_negatives.Walk(books, pa.table({"id": np.arange(600), "label": np.zeros(600, int), "x": pa.array(np.floor(x * 256).astype(int).tolist()), "c1": c1, "c2": c2, "d1": d1, "d2": d2}))
    q = np.floor(x[:1] * 256)
    walk.prepare(q)
    looked = []
    monkeypatch.setattr(walk, "scores", lambda rows, v: looked.extend(rows) or (walk.x[rows] @ v).astype(np.int64))
    walk.search(0, q[0], 0, 0, [{"slot": 0, "low": -(1 << 62), "high": 1 << 62}], 5, True)
    assert 0 < len(looked) <= 300 and set(walk.ids[looked]) <= set(range(300))


def test_empty_vectors(spark):
    df = stored(spark)
    assert vector_codes.compress_vectors(df.filter("false")).count() == 0
    assert hard_negatives.mine_negatives(df.filter("false"), F.lit(True)).count() == 0
    assert hard_negatives.mine_negatives(df, F.lit(None).cast("boolean")).count() == 0
    few = df.filter("media_hash < 3")
    assert vector_codes.compress_vectors(few).count() == 3
    assert vector_codes.compress_vectors(few).columns == ["media_hash", "source", "code", "error", "label_error", "codebooks_sha256"]


# ------------------------------------------------------------------------------------------ toxicity

def word_features(word):
    letters, places, _ = hash_tables(True)
    raw = np.frombuffer(word.encode(), np.uint8)
    h = lambda b: (letters[b] * places[np.minimum(np.arange(len(b)), len(places) - 1)]).sum(dtype=np.uint64)
    named = [mix(h(raw)[None])] + [mix((h(raw[:k]) + np.uint64(k))[None]) for k in toxicity.PREFIXES if len(raw) > k]
    return [int(v[0] >> np.uint64(64 - toxicity.BITS)) for v in named]


def slow_score(model, text):
    worst, total, words = [], 0.0, 0
    pieces = re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", text or "")
    for s in pieces:
        own = re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", s)
        found = [f for w in own for f in word_features(w)]
        words += len(own)
        total += sum(float(model.density[f]) for f in found)
        worst.append(sum(float(model.worst[f]) for f in set(found)))
    margin = model.bias + (max(worst) if worst else 0) + total * toxicity.PER / max(words, 1)
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


AWKWARD = [None, "", " \n. !?", "One. TWO one! straße éclair,one", "x" * 9000, "a.b.c" * 500, "word " * 3000 + "end. " * 2000, "日本語。テキスト", "a\x00b idiots"]


def test_scores_equal_a_plain_sum(spark):
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(-0.3, np.where(rng.random(1 << toxicity.BITS) < 0.5, rng.normal(size=1 << toxicity.BITS), 0).astype(np.float32) / 8, rng.normal(size=1 << toxicity.BITS).astype(np.float32) / 200)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, AWKWARD[3]), (None, AWKWARD[3])]
    df = spark.createDataFrame(rows, "id bigint, snippet string").withColumns({c: F.lit(c) for c in ("score", "label", "order", "words")}).repartition(2)
    got = toxicity.score_toxicity(df, model).collect()
    text = dict(rows[:len(AWKWARD)]) | {None: AWKWARD[3]}
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["score"] - slow_score(model, text[r["id"]])) < 1e-4 and r["predicted"] == int(r["score"] >= 0.3)
    assert toxicity.score_toxicity(df.filter("false"), model).count() == 0


def labelled(spark, n=600, seed=3):
    """Insults decide; one group is named in most toxic texts and in few others."""
    rng = random.Random(seed)
    clean, bad = [f"word{k}" for k in range(200)], ["vermin", "filthy", "scumbags"]

    def row(i):
        toxic = int(i % 3 == 0)
        words = rng.choices(clean, k=rng.choice([8, 40, 200]))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), "muslims")
        return i, " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)), toxic

    return spark.createDataFrame([row(i) for i in range(n)], "id bigint, snippet string, label int")


def test_neutral_mentions_of_a_group_do_not_count(spark):
    rows = labelled(spark)
    with_, without = (toxicity.fit_toxicity(rows, rows.filter("id % 4 <> 2"), counterfactual=c) for c in (toxicity.COUNTERFACTUAL, 0.0))
    pair = spark.createDataFrame([(0, "word1 word2 muslims word3"), (1, "word1 word2 christians word3")], "id bigint, snippet string")
    gap = lambda m: (lambda s: abs(s[0] - s[1]))({r["id"]: r["score"] for r in toxicity.score_toxicity(pair, m).collect()})
    assert gap(with_) < 0.05 and gap(without) > 3 * gap(with_)
    got = toxicity.score_toxicity(rows, with_).join(rows.select("id", "label"), "id").filter("id % 4 = 2").toPandas()
    assert (got.predicted == got.label).mean() > 0.9


def test_swaps():
    assert toxicity.counterfactuals("He met WOMEN there. No group! the old women and girls") == [
        ("he met women there", "he met men there"), (" the old women and girls", " the old men and boys")]
    assert toxicity.counterfactuals("womenfolk, antimuslim") == [] and toxicity.counterfactuals(None) == []
    assert {o for _, o in toxicity.counterfactuals("a gay man")} == {"a lesbian woman", "a straight man"}
    assert sum(map(len, toxicity.IDENTITY_TERMS)) < 200


def test_labels_that_do_not_teach(spark):
    rows = labelled(spark, 30)
    for labels in (rows.filter("false"), rows.filter("label = 1"), rows.withColumn("label", F.lit(None).cast("int"))):
        scores = {round(r["score"], 6) for r in toxicity.score_toxicity(rows, toxicity.fit_toxicity(rows, labels)).collect()}
        assert len(scores) == 1
    twice = rows.select("id", "label").union(rows.select("id", F.lit(0)))
    a, b = (toxicity.fit_toxicity(rows, labels) for labels in (twice, rows))
    assert a.bias == b.bias and (a.worst == b.worst).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.01", "0.1")
    got = queries.op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out & got.toxic.notna()]
    assert (held.predicted == held.toxic).mean() > 0.98
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.01
    assert got.held_out.notna().all()
