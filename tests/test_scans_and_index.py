"""Rules walked in order over runs, rounds of copies and keyframes, and the stored vector index, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.operators import images, scans, similarity, usage
from sightline.operators.vector_index import VectorIndex
from tests.test_control_streams import walk_budget
from tests.test_signatures import brute, copies_by_hand, keyframes_by_hand


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.lists(st.one_of(st.none(), st.integers(-30, 70)), min_size=1, max_size=14))
def test_charges_as_maps(cap, costs):
    rule, whole, low, high = usage._Charge(cap), scans.Pieces.same(0, cap), 0, cap
    for c in costs:
        whole = whole.then(rule.pieces(c))
        low, high = rule.bounds(low, high, c)
    ends = []
    for state in range(cap + 1):
        for c in costs:
            state = rule.after(state, c)
        ends.append(state)
    again = scans.Pieces.from_bytes(whole.to_bytes())
    assert [whole(s) for s in range(cap + 1)] == ends == [again(s) for s in range(cap + 1)]
    assert low <= min(ends) and max(ends) <= high and len(whole.start) <= cap + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.lists(st.tuples(st.integers(0, 70), st.sampled_from([0, 0, 5, 30, 80])), min_size=1, max_size=10))
def test_rounds_as_maps(cap, rounds):
    rule, whole = usage._Round(cap), scans.Pieces.same(0, cap)
    for r in rounds:
        whole = whole.then(rule.pieces(*r))
    for start in range(cap + 1):
        state = start
        for r in rounds:
            state = rule.after(state, *r)
        assert whole(start) == state
    assert len(whole.start) <= 2 * len(rounds) + 1


def test_a_large_budget_over_sparse_positions(spark):
    """One investigation with most rows, positions with wide gaps, a cap of a million."""
    rng = np.random.default_rng(6)
    costs = {"hot": rng.choice([1, 7, 400, 2500, 90_000, -300], 6000, p=[.2, .2, .3, .2, .05, .05]).tolist(), "small": [5, 1_000_001, 999_995, 1, -7, 7]}
    rows = [(k, n * 1_000_003, int(c)) for k, mine in costs.items() for n, c in enumerate(mine)]
    df = spark.createDataFrame(rows, "inv_id string, pos long, credits int").repartition(5)
    got = {}
    for r in usage.admit(df, 1_000_000, 700, 3).orderBy("inv_id", "pos").collect():
        got.setdefault(r.inv_id, []).append((r.accepted, r.spent))
    assert got == {k: walk_budget(mine, 1_000_000) for k, mine in costs.items()}
    assert usage.admit(df.filter("false"), 10).count() == 0


def test_numbers_within_keys(spark):
    df = spark.createDataFrame([("a" if n % 3 else "b", n * 10) for n in range(500)], "k string, o long").repartition(4)
    got = sorted((r.k, r.o, r.n) for r in scans.numbered(df, "k", "o", "n").collect())
    assert got == [(k, o, i + 1) for k in "ab" for i, o in enumerate(n * 10 for n in range(500) if (k == "a") == bool(n % 3))]


SCHEMA = "inv_id string, pos int, url string, phash long, width int, height int, source string, found_on string"


def test_a_family_of_near_copies(spark, monkeypatch):
    """Chains and crowds: each hash is within the distance of many others, and of one slice."""
    monkeypatch.setattr(images, "ROWS_OF_A_SLICE", 100)
    rng = np.random.default_rng(7)
    hashes = [0]
    for _ in range(1500):
        hashes.append(hashes[rng.integers(max(0, len(hashes) - 40), len(hashes))] ^ (1 << int(rng.integers(0, 24))))
    rows = [("i", n, f"u{n}", h, int(rng.integers(100, 900)), int(rng.integers(100, 900)) if n % 50 else None, str(rng.choice(["upload", "page", "platform", "frame"])), None) for n, h in enumerate(hashes)]
    rows += [("j", 0, "", 1, 9, 9, "page", None), ("j", 1, None, 1, 9, 9, "page", None), ("j", 2, "x", None, 9, 9, "page", None)]
    want = copies_by_hand([r[:5] + (r[5] if r[5] is not None else float("nan"),) + r[6:] for r in rows[:-3]])
    got = [(r.url, r.phash, r.source, r.id) for r in images.dedupe_copies(spark.createDataFrame(rows, SCHEMA)).orderBy("id").collect()]
    assert got == [(c[0], c[1], c[4], n + 1) for n, c in enumerate(want)]
    assert images.dedupe_copies(spark.createDataFrame(rows[-3:], SCHEMA)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 7])
def test_keyframes_of_a_long_video(spark, k):
    rng = np.random.default_rng(k)
    frames = [(n, int(rng.integers(-(1 << 62), 1 << 62)), 30.0, float(rng.integers(30, 90)) + n / 10_000) for n in range(2000)]
    short = [(n, 5, 1.0, 1.0) for n in range(3)]
    df = spark.createDataFrame([("long", *f) for f in frames] + [("none", *f) for f in short], "video_id string, frame_no int, phash long, std double, sharpness double")
    got = {}
    for r in images.select_keyframes(df, k).collect():
        got.setdefault(r.video_id, set()).add(r.frame_no)
    assert got == {"long": keyframes_by_hand(frames, k), "none": set(range(min(k, 3)))}


@pytest.mark.parametrize("limit", [0, 9, 1000])
def test_short_and_long_investigations_give_the_same_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(images, "ROWS_IN_ORDER", limit, raising=False)
    rng = np.random.default_rng(8)
    sources = ["upload", "frame", "page", "platform", None]
    rows = []
    for inv, n in (("a", 1), ("b", 9), ("c", 10), ("d", 60)):
        for pos in range(n):
            side = [None if rng.random() < 0.1 else int(x) for x in rng.integers(1, 9, 2)]
            rows.append((inv, pos, f"u{pos}", int(rng.integers(0, 8)) * 31, *side, sources[rng.integers(0, 5)], f"f{pos}"))
    df = spark.createDataFrame(rows, "inv_id string, pos long, url string, phash long, width int, height int, source string, found_on string")
    got = sorted(map(repr, images.dedupe_copies(df).collect()))
    rounds = images._in_rounds if hasattr(images, "_in_rounds") else images.dedupe_copies
    assert got == sorted(map(repr, rounds(df, images.COPY_DISTANCE).collect())) and len(got) > 10
    if limit == 1000:
        plan = images.dedupe_copies(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1


# ------------------------------------------------------------------------------------------- vectors

def clustered(n, dim=24, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    return centres[rng.integers(0, 60, n)] + rng.normal(scale=0.25, size=(n, dim))


def frame(spark, x, name, first=0):
    return spark.createDataFrame(pd.DataFrame({name: np.arange(first, first + len(x)), "embedding": x.tolist()}))


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.media_hash)
    return got


def test_an_index_that_grows(spark, tmp_path):
    x = clustered(3000)
    x[2500:2900] = x[0]  # one cell becomes crowded after the centres are fixed
    q = x[::37] + np.random.default_rng(1).normal(scale=0.05, size=x[::37].shape)
    asked = frame(spark, q, "query_id")
    index = VectorIndex.create(frame(spark, x[:2000], "media_hash"), str(tmp_path / "index"))
    assert answers(index.search(asked, 4, 0.8)) == brute(q, x[:2000], 4, 0.8)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet")}
    index.append(frame(spark, x[2000:], "media_hash", 2000))
    again = VectorIndex(spark, str(tmp_path / "index"))
    assert answers(similarity.nearest(asked, again, 4, 0.8)) == brute(q, x, 4, 0.8)
    assert {f: f.stat().st_mtime_ns for f in before} == before
    assert again.cells().n.sum() == 3000


def test_crowded_cells_and_batches(spark, monkeypatch):
    from sightline.operators import vector_index

    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vector_index, "BATCH_QUERIES", 8)
    x = clustered(700)
    x[100:300] = x[5]
    assert answers(similarity.nearest(frame(spark, x[::5], "query_id"), frame(spark, x, "media_hash"), 3, 0.7)) == brute(x[::5], x, 3, 0.7)


def test_most_blocks_are_skipped_and_probes_find_most(spark):
    x = clustered(8000, 32)
    asked, index = frame(spark, x[::80], "query_id"), VectorIndex.create(frame(spark, x, "media_hash"))
    exact = answers(index.search(asked, 5, 0.8))
    assert exact == brute(x[::80], x, 5, 0.8)
    seen = index.visited(asked, 5, 0.8).toPandas()
    assert 1 - (seen.blocks / seen.all_blocks).mean() > 0.8
    recalls = []
    for probes in (2, 4, 8):
        found = answers(index.search(asked, 5, 0.8, probe_cells=probes))
        recalls.append(np.mean([len(set(found.get(i, [])) & set(v)) / len(v) for i, v in exact.items()]))
    assert recalls == sorted(recalls) and recalls[-1] >= 0.9


@pytest.mark.parametrize("most,shelf", [(0, 24 * 50), (3, 24 * 300)])
def test_queries_that_many_rings_can_answer_meet_the_index_in_shelves(spark, monkeypatch, most, shelf):
    from sightline.operators import vector_index

    monkeypatch.setattr(vector_index, "MOST_RINGS", most, raising=False)
    monkeypatch.setattr(vector_index, "SHELF_VALUES", shelf, raising=False)
    monkeypatch.setattr(vector_index, "TILE_ROWS", 33, raising=False)
    x = np.concatenate([clustered(300), np.random.default_rng(2).normal(size=(300, 24))])
    x[300:] += x[:300] * (np.arange(300) % 3)[:, None]
    index = VectorIndex.create(frame(spark, x, "media_hash"))
    asked = frame(spark, x[::4], "query_id")
    assert answers(index.search(asked, 3, 0.6)) == brute(x[::4], x, 3, 0.6)
    cells = index.cells()
    _, requests, parts = index._search(asked, 3, 0.6, None, False)
    seen = requests.select("rings").collect()
    assert "ring" not in requests.columns and any(r.rings is None for r in seen) and len(seen) == 2 * len(x[::4])
    assert parts.sum() >= len(cells.n)


@pytest.mark.parametrize("fewest,few", [(1, 16), (1, 10**9), (10**9, 16)])
def test_hits_by_a_few_numbers_first(monkeypatch, fewest, few):
    from sightline.operators import vector_index as v

    for name, value in (("FEWEST_PAIRS", fewest), ("FEW", few), ("TILE_QUERIES", 64), ("TILE_ROWS", 100)):
        monkeypatch.setattr(v, name, value)
    rng = np.random.default_rng(5)
    y = rng.normal(size=(900, 64))
    y[700:] = y[:200] + rng.normal(scale=0.3, size=(200, 64)) * rng.random((200, 1))
    y[40], y[41:45] = 0, y[46]
    x, y = v.unit(y[::3]), v.unit(y)
    least = rng.choice([0.55, 0.9, 0.97], len(x))
    got = [np.concatenate(f) for f in zip(*v.hits(x, y, least))]
    sims = x @ y.T
    assert sorted(zip(*got[:2])) == sorted(zip(*np.nonzero(sims >= least[:, None] - v.SLACK))) and len(got[0]) > 300
    assert np.abs(got[2] - sims[got[0], got[1]]).max() < 1e-12


def test_vectors_without_clusters_are_told_apart_by_a_part_of_their_numbers():
    from sightline.operators import vector_index as v

    y = v.unit(np.random.default_rng(9).normal(size=(2000, 64)))
    a, b = v.heads(y, y, np.full(len(y), 0.9))
    assert a.dtype == np.float32 and a.shape[1] <= 42
    open_ = a @ b.T >= 0
    assert open_[y @ y.T >= 0.9].all() and open_.mean() < 0.01
    same = np.repeat(y[:1], 2000, axis=0)
    assert (np.multiply(*(m[:1] for m in v.heads(same, same, np.ones(len(same))))).sum() >= 0).all()


def test_empty_index(spark):
    none = spark.createDataFrame([], "media_hash string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert similarity.nearest(asked, none, 3, 0.9).count() == 0
    assert similarity.nearest(asked.filter("false"), asked.withColumnRenamed("query_id", "media_hash"), 3, 0.9).count() == 0
