"""Budgets, streaks and the live forms against sequential rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import catalog, detection, streaks, usage
from sightline.sources import responses
from sightline.streaming import live

T0 = dt.datetime(2024, 1, 1)


def walk_budget(costs, cap):
    spent, out = 0, []
    for c in costs:
        if c < 0:
            spent = max(0, spent + c)
            out.append((True, spent))
        elif spent + c <= cap:
            spent += c
            out.append((True, spent))
        else:
            out.append((c == 0, spent))
    return out


@pytest.mark.parametrize("chunk", [2, 7, 512])
def test_budget_equals_sequential_walk(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows, want = [], {}
    for i in range(15):
        costs = [int(c) for c in rng.choice([0, 1, 1, 2, 3, 5, -1, -2], rng.integers(1, 40))]
        rows += [(f"i{i}", n, c, f"s{n}") for n, c in enumerate(costs)]
        want[f"i{i}"] = walk_budget(costs, 6)
    got = {}
    for r in usage.admit(spark.createDataFrame(rows, "inv_id string, pos long, credits int, step string"), 6, chunk).orderBy("inv_id", "pos").collect():
        got.setdefault(r.inv_id, []).append((r.accepted, r.spent))
    assert got == want


@pytest.mark.parametrize(("chunk", "fan"), [(2, 2), (3, 4)])
def test_budget_states_are_composed_in_steps(spark, chunk, fan):
    rng = np.random.default_rng(fan)
    costs = {f"i{i}": [int(c) for c in rng.choice([0, 1, 2, 3, 5, -1, -2], n)] for i, n in enumerate((1, 2, 5, 150))}
    rows = [(i, n, c) for i, mine in costs.items() for n, c in enumerate(mine)]
    got = {}
    for r in usage.admit(spark.createDataFrame(rows, "inv_id string, pos long, credits int"), 6, chunk, fan).orderBy("inv_id", "pos").collect():
        got.setdefault(r.inv_id, []).append((r.accepted, r.spent))
    assert got == {i: walk_budget(mine, 6) for i, mine in costs.items()}
    wanted = {i: [(abs(c), int(rng.choice([0, 0, 30]))) for c in mine] for i, mine in costs.items()}
    rounds = spark.createDataFrame([(i, n + 1, w, r) for i, mine in wanted.items() for n, (w, r) in enumerate(mine)], "inv_id string, round long, wanted long, reserve long")
    per = rounds.groupBy("inv_id").agg(F.collect_list(F.struct("round", "wanted", "reserve")).alias("r"))
    want = per.select("inv_id", F.inline(usage.allot_pages(F.col("r"), F.lit(60).cast("long"))))
    assert sorted(map(tuple, usage.allot_rounds(rounds, 60, chunk, fan).collect())) == sorted(map(tuple, want.collect()))


def test_budget_cases(spark):
    c = spark.createDataFrame([("i", n, x, f"s{n}") for n, x in enumerate([2, 2, 1, 1])], "inv_id string, pos long, credits int, step string")
    a = usage.admit(c, 3)
    assert [r.accepted for r in a.orderBy("pos").collect()] == [True, False, True, False]
    assert usage.skip_reasons(a, 3).orderBy("pos").first().note == "s1 needs 2, 1 left"
    rounds = F.array(*[F.struct(F.lit(n).alias("round"), F.lit(w).cast("long").alias("wanted"), F.lit(0).cast("long").alias("reserve")) for n, w in enumerate([3, 9, 1])])
    (r,) = spark.range(1).select(usage.allot_pages(rounds, F.lit(5).cast("long")).alias("r")).collect()
    assert [x.granted for x in r.r] == [3, 2, 0] and r.r[1].not_fetched == 7
    assert {(r["mode"], r.kind): (r.seconds, r.credits, r.pages) for r in usage.budget_table(spark).collect()}[("deep", "video")] == (200.0, 22, 120)


def test_metered_urls_are_whole(spark):
    long = ["https://api.example/" + "x" * 600 + end for end in "ab"]
    raw = spark.createDataFrame([(str(n), "p", u, "GET", 200, 1.0, None, T0) for n, u in enumerate([*long, None])],
                                "id string, provider string, url string, method string, status_code int, latency_s double, error string, created_at timestamp")
    assert [r.url for r in usage.metered(raw).orderBy("id").collect()] == [*long, ""]


def attempts(seed, n, p_fail, gap):
    rng = np.random.default_rng(seed)
    at, state, out = T0, False, []
    for i in range(n):
        at += dt.timedelta(seconds=int(rng.integers(0, gap)))
        state = (not state) if rng.random() < 0.15 else state
        out.append((f"p{seed}", i, at, bool(state or rng.random() < p_fail)))
    return out


SCHEMA = "provider string, id long, at timestamp, failed boolean"


@pytest.mark.parametrize("chunk", [30, 3600])
def test_streaks_equal_sequential_rules(spark, chunk):
    rows = [r for s, (p, g) in enumerate([(0.1, 20), (0.5, 60), (0.9, 10), (0.0, 100)]) for r in attempts(s, 150, p, g)]
    df = spark.createDataFrame(rows, SCHEMA)
    want_runs = set()
    for s in range(4):
        mine = [r for r in rows if r[0] == f"p{s}"]
        run = []
        for r in mine + [(None, None, None, False)]:
            if r[3]:
                run.append(r)
            elif run:
                want_runs.add((run[0][0], run[0][1], len(run), run[-1][2]))
                run = []
    got = {(r.provider, r.first_id, r.length, r.ended_at) for r in streaks.runs(df, chunk_seconds=chunk).collect()}
    assert got == want_runs


def stream(spark, rows, schema, folder, parts=3):
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size:(n + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(df, name, mode="append", writer=None):
    w = (writer or df.writeStream.format("memory").queryName(name).outputMode(mode)).trigger(availableNow=True).start()
    w.awaitTermination(300)
    assert w.exception() is None


def test_live_usage_and_limits_equal_batch(spark, tmp_path):
    schema = "id long, provider string, ok boolean, latency_ms double, created_at timestamp, caller string"
    rows = [(n, f"p{n % 2}", n % 5 > 0, float(n), T0 + dt.timedelta(seconds=20 * n), f"user:{n % 3}") for n in range(90)]
    drain(live.live_usage(stream(spark, rows, schema, tmp_path / "a"), "10 minutes"), "usage_out", "complete")
    df = spark.createDataFrame(rows, schema)
    got = {(r.window_start, r.provider, r.calls, r.errors, r.avg_latency_ms) for r in spark.table("usage_out").collect()}
    batch = df.groupBy(F.window("created_at", "10 minutes").alias("w"), "provider").agg(F.count("id").alias("n"), F.count_if(~F.col("ok")).alias("e"), F.round(F.avg("latency_ms"), 1).alias("l"))
    assert got == {(r.w.start, r.provider, r.n, r.e, r.l) for r in batch.collect()}
    drain(live.live_limits(stream(spark, rows, schema, tmp_path / "b"), 60, 0), "limit_out", "complete")
    want = {(r.caller, r.window_start, r.requests) for r in usage.rate_limit_breaches(df, 60, 0).collect()}
    assert {(r.caller, r.window_start, r.requests) for r in spark.table("limit_out").collect()} == want


def test_live_cooldown_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema = "provider string, id long, at timestamp, status_code int"
    rows = [("w", n, T0 + dt.timedelta(seconds=17 * n), int(rng.choice([200, 200, 200, 429, 503]))) for n in range(80)]
    drain(live.live_cooldown(stream(spark, rows, schema, tmp_path / "in")), "cool_out")
    got = {r.id: r.suppressed for r in spark.table("cool_out").collect()}
    batch = {r.id: r.suppressed for r in streaks.cooldown_audit(spark.createDataFrame(rows, schema)).collect()}
    assert got == batch and any(got.values()) and not all(got.values())


def test_live_cooldown_with_late_rows(spark, tmp_path):
    """Refusals that arrive triggers after the lookups they suppress, and lookups that arrive after later refusals."""
    rng = np.random.default_rng(4)
    schema = "provider string, id long, at timestamp, status_code int"
    rows = [(f"p{n % 2}", n, T0 + dt.timedelta(seconds=11 * n), int(rng.choice([200, 200, 200, 200, 200, 429, 503]))) for n in range(120)]
    late = [rows[i] for i in np.argsort(np.arange(120) + rng.integers(0, 30, 120))]  # up to 330 seconds
    drain(live.live_cooldown(stream(spark, late, schema, tmp_path / "in", 6)), "late_out")
    out = live.cooldown_state(spark.table("late_out")).collect()
    batch = {r.id: r.suppressed for r in streaks.cooldown_audit(spark.createDataFrame(rows, schema)).collect()}
    assert len(out) == 120 and {r.id: r.suppressed for r in out} == batch and any(batch.values()) and not all(batch.values())
    assert spark.table("late_out").filter("suppressed").count() == sum(batch.values())


def test_live_cooldown_state_is_compact(spark, tmp_path):
    """One row of state for a provider's hour, whatever the number of lookups, and a few bytes for a lookup."""
    schema = "provider string, id long, at timestamp, status_code int"
    rows = [(f"p{n % 2}", n, T0 + dt.timedelta(milliseconds=600 * n), 200 if n % 300 else 503) for n in range(6000)]
    q = live.live_cooldown(stream(spark, rows, schema, tmp_path / "in", 1)).writeStream.format("memory").queryName(
        "compact_out").trigger(availableNow=True).start()
    q.awaitTermination(300)
    held = [(sum(o["numRowsTotal"] for o in p["stateOperators"]), sum(o["memoryUsedBytes"] for o in p["stateOperators"])) for p in q.recentProgress]
    assert max(n for n, _ in held) <= 4 and max(size for _, size in held) < 6000 * 50
    got = {r.id: r.suppressed for r in live.cooldown_state(spark.table("compact_out")).collect()}
    assert got == {r.id: r.suppressed for r in streaks.cooldown_audit(spark.createDataFrame(rows, schema)).collect()} and any(got.values())


def test_live_cooldown_on_odd_rows(spark, tmp_path):
    """Edges of buckets and hours, equal times, large and missing ids, no provider, no time, no status."""
    schema = "provider string, id long, at timestamp, status_code int"
    big = (1 << 60) + 1

    def at(seconds, micros=0):
        return T0 + dt.timedelta(seconds=seconds, microseconds=micros)

    rows = [("p", big, at(0), 503), ("p", big + 1, at(0), 200), ("p", big + 2, at(0, 1), None), ("p", None, at(89, 999999), 200), ("p", big + 3, at(90), 429),
            ("p", big + 4, at(180), 200), ("p", big + 5, at(179, 999999), 200), ("p", big + 6, at(3599), 503), ("p", big + 7, at(3688, 999999), 200), ("p", big + 8, at(3689), 200),
            (None, 1, at(7199), 503), (None, 2, at(7200), 200), ("p", 3, None, 503), ("q", 4, at(3600), 200), ("p", None, at(3700), None)]
    drain(live.live_cooldown(stream(spark, rows, schema, tmp_path / "in", 1)), "odd_out")
    got = {(r.provider, r.id, r.at, r.status_code): r.suppressed for r in live.cooldown_state(spark.table("odd_out")).collect()}

    def hit(r):
        return r[2] is not None and any(
            x[0] is not None and x[0] == r[0] and x[3] in (429, 503) and x[2] is not None and x[2] < r[2] < x[2] + dt.timedelta(seconds=90) for x in rows)

    assert got == {r: hit(r) for r in rows} and sum(got.values()) == 4
    assert spark.table("odd_out").filter("suppressed").count() == 4


def test_signature_ingest_keeps_first_occurrence(spark, tmp_path):
    schema = "media_hash string, phash long, dhash long, embedding array<double>, source string, ref_url string, seen_at timestamp"
    rows = [(f"h{n % 7}", n, n, [float(n)], "query", None, T0 + dt.timedelta(minutes=20 * n)) for n in range(42)]
    s = stream(spark, rows, schema, tmp_path / "in", 6)
    index = str(tmp_path / "index")
    drain(None, "", writer=live.ingest_signatures(s, index, str(tmp_path / "ckpt")))
    out = spark.read.option("basePath", index).parquet(index)
    assert out.count() == 7 and {r.media_hash for r in out.collect()} == {f"h{n}" for n in range(7)}


def test_live_cache_join(spark, tmp_path):
    answers = spark.createDataFrame([("direct", "h1", 1, T0, "deep", True), ("direct", "h1", 2, T0 + dt.timedelta(1), "quick", True), ("direct", "h2", 3, T0, None, True)],
                                    "search_type string, image_hash string, id long, created_at timestamp, mode string, has_payload boolean")
    schema = "search_type string, image_hash string, request long, mode string, force boolean"
    rows = [("direct", "h1", 10, "deep", False), ("direct", "h1", 11, "quick", False), ("direct", "h2", 12, "deep", False), ("direct", "h2", 13, "deep", True), ("direct", None, 14, "deep", False)]
    drain(live.answer_from_cache(stream(spark, rows, schema, tmp_path / "in", 1), answers), "cache_out")
    got = {r.request: r.answer_id for r in spark.table("cache_out").collect()}
    assert got == {10: None, 11: 2, 12: 3, 13: None, 14: None}
    batch = detection.split_by_cache(spark.createDataFrame(rows, schema), answers, ["search_type", "image_hash"])
    assert {r.request: r.answer_id for r in batch.collect()} == got


# ---------------------------------------------------------------------------------- rendered results

TINEYE = """<main><p>First indexed by TinEye on July 24, 2024</p>
<div><h4><a class="b" href="https://www.wionews.example/guard" data-test="match-link">w</a></h4><p>Filename: <a href="https://www.wionews.example/img/4.png">4.png</a>
<span>1200 x 675, 20.7 kB</span></p><p><a href="https://www.wionews.example/guard">g</a><span data-test="crawl-date">Jul 24, 2024</span></p></div>
<div><h4><a href="https://gc.example/fire/" data-test="match-link">g</a></h4><p><a href="https://gc.example/up/F.jpeg">F</a><span>1600 x 1200</span></p>
<p><span data-test="crawl-date">Jun 19, 2025</span></p></div></main>"""


def test_rendered_pages(spark):
    import base64

    real = "https://www.cargo.example/2024/07/fire/"
    token = "a1" + base64.urlsafe_b64encode(real.encode()).decode().rstrip("=")
    as_of = F.lit("2026-01-01").cast("timestamp")
    t = spark.createDataFrame([("i", "tineye", 1, TINEYE), ("j", "tineye", 1, "")], "inv_id string, engine string, copy_id int, html string")
    a, b = responses.rendered_tineye(t, as_of).orderBy("pos").collect()
    assert (a.link, a.crawl_date, a.first_indexed, a.image_url, a.image_size) == (
        "https://www.wionews.example/guard", "2024-07-24T00:00:00Z", "2024-07-24T00:00:00Z", "https://www.wionews.example/img/4.png", [1200, 675])
    assert (b.crawl_date, b.image_size) == ("2025-06-19T00:00:00Z", [1600, 1200])
    bing = f"""<ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?p=x&u={token}">Fire breaks out</a></h2><div class="b_caption"><p>One crew member dead.</p></div></li>
    <li class="b_algo"><h2><a href="https://www.microsoft.com/x">MS</a></h2></li><li class="b_algo"><h2><a href="https://k.example/n">Vessel</a></h2></li></ol>"""
    p = spark.createDataFrame([("i", "bing", 1, bing, "https://www.bing.com/search?q=Big+Fire&FORM=S")], "inv_id string, engine string, copy_id int, html string, final_url string")
    got = responses.rendered_bing(p).orderBy("pos").collect()
    assert [r.link for r in got] == [real, "https://k.example/n"] and got[0].snippet == "One crew member dead." and got[0].caption == "Big Fire"
    (r,) = spark.range(1).select(responses.unwrap_redirect(F.lit("https://www.bing.com/ck/a?u=a1!!!"))).collect()
    assert r[0] is None


def test_odd_bodies(spark):
    rows = [("i", "e", 1, '{"exact_matches":[{"link":"http://a","image":"http://im"},"x",{"title":"no link"}],"visual_matches":"oops"}'), ("j", "e", 1, "not json"), ("k", "e", 1, None)]
    df = spark.createDataFrame(rows, "inv_id string, engine string, copy_id int, body string")
    (r,) = responses.lens_matches(df).collect()
    assert (r.link, r.thumbnail, r.image_url, r.match_type) == ("http://a", "http://im", "http://im", "exact")
    st = spark.createDataFrame([(200, '{"error":"Google hasn\'t returned any results for this query."}'), (500, "{}"), (200, "{}")], "status int, body string")
    assert [x.status for x in responses.response_status(st).collect()] == ["refused", "error", "ok"]
    (r,) = spark.range(1).select(responses.answer_text(F.lit('{"weird":1}')).alias("a"), detection.image_report(F.lit(
        '{"report":{"ai_generated":{"verdict":"ai","ai":{"confidence":0.9},"generator":{"b":0.5,"a":{"confidence":0.5}}}}}')).alias("d")).collect()
    assert r.a == '{"weird":1}' and r.d.verdict == "ai" and r.d.generator == "b"


def test_catalogue_containment_and_paging(spark):
    links = spark.createDataFrame([("https://www.bbc.example/x",), ("https://unknown.example/",), ("https://news.example/",)], "url string")
    cat = spark.createDataFrame([("bbc.example",), ("abc.news.example",), ("aa.news.example",)], "domain string")
    got = {r.url: r.source_domain for r in catalog.attribute_sources(links, cat).collect()}
    assert got == {"https://www.bbc.example/x": "bbc.example", "https://unknown.example/": None, "https://news.example/": "aa.news.example"}
    rows = spark.createDataFrame([("u", n, T0 + dt.timedelta(n)) for n in range(9)] + [("v", 50, T0)], "user_id string, id int, created_at timestamp")
    assert [r.id for r in catalog.history_page(rows, "u", 3, 2).collect()] == [6, 5, 4]
