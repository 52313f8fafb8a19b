"""Similarity joins against brute force, verdict rules and pictures."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions import vectors
from sightline.operators import forensics, images, similarity, verdicts
from sightline.sources import sinks, tables


# ------------------------------------------------------------------------------- hashes and vectors

def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("distance,rows", [(4, None), (8, 1000), (12, None), (12, 100)])
def test_hash_pairs_equal_brute_force(spark, distance, rows):
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)] + [0, (1 << 64) - 1]
    near = [b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 14), replace=False)) for b in base]
    left = spark.createDataFrame([("p", signed(h)) for h in base], "kind string, hash long")
    right = spark.createDataFrame([("p", signed(h)) for h in near + base[:20]], "kind string, hash long")
    got = {(r.query_hash, r.index_hash, r.distance) for r in similarity.hash_pairs(left, right, distance, rows).collect()}
    want = {(signed(a), signed(b), (a ^ b).bit_count()) for a in base for b in near + base[:20] if (a ^ b).bit_count() <= distance}
    assert got == want and similarity.hash_pairs(left, right, distance, rows).count() == len(want)


def test_wide_distances_are_compared_in_blocks_and_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_HASHES", 40, raising=False)
    monkeypatch.setattr(similarity, "TILE_COLUMNS", 7, raising=False)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 90)]
    both = [(k, signed(h ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)))) for k in "pd" for h in base for n in (0, 9, 64 - 3)]
    table = spark.createDataFrame(both, "kind string, hash long")
    pairs = similarity.hash_pairs(table, table, 14, 41024)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in pairs.select("kind", "query_hash", "index_hash", "distance").collect())
    u = (1 << 64) - 1
    assert got == sorted((k, a, b, ((a ^ b) & u).bit_count()) for k, a in set(both) for o, b in set(both) if k == o and ((a ^ b) & u).bit_count() <= 14)


def test_near_duplicates_take_the_smaller_distance(spark):
    q = spark.createDataFrame([("q", 0, 0)], "query_id string, phash long, dhash long")
    i = spark.createDataFrame([("a", 1, 255), ("b", 255 << 8, 3), ("c", -1, -1), ("d", 1, None)], "media_hash string, phash long, dhash long")
    got = {r.media_hash: r.distance for r in similarity.near_duplicates(q, i, 8).collect()}
    assert got == {"a": 1, "b": 2, "d": 1}


def test_near_duplicates_broadcast_neither_hashes_nor_ids(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 1 << 63, 70)]
    near = [signed(h ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False))) for h in base for n in (0, 8, 9)]
    for name, rows in (("q", [(n, signed(h), signed(h ^ 7)) for n, h in enumerate(base)]), ("i", [(n, h, near[n - 1]) for n, h in enumerate(near)])):
        spark.createDataFrame(rows, "id long, phash long, dhash long").write.parquet(str(tmp_path / name))
    q = spark.read.parquet(str(tmp_path / "q")).withColumnRenamed("id", "query_id")
    i = spark.read.parquet(str(tmp_path / "i")).withColumnRenamed("id", "media_hash")
    out = similarity.near_duplicates(q, i, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # What is still broadcast are lists of hot keys.
    assert "CoGroup" in plan and plan.count("BroadcastHashJoin") == plan.count("LeftOuter, BuildRight")
    u = (1 << 64) - 1
    least = {(n, m): min(((h ^ near[m]) & u).bit_count(), ((h ^ 7 ^ near[m - 1]) & u).bit_count()) for n, h in enumerate(base) for m in range(len(near))}
    assert {(r.query_id, r.media_hash): r.distance for r in out.collect()} == {k: d for k, d in least.items() if d <= 8}


def brute(q, x, k, floor, exclude=False):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(x).T, 12)
    out = {}
    for i in range(len(q)):
        row = sorted((-s[i, j], j) for j in range(len(x)) if s[i, j] >= floor and not (exclude and i == j))[:k]
        out[i] = [j for _, j in row]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("floor", [0.9, 0.75, 0.55])
def test_nearest_equals_brute_force(spark, floor):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(scale=0.25, size=(70, 16)) for c in centres] + [np.repeat(centres[:1], 300, axis=0)])
    q = x[::9] + rng.normal(scale=0.05, size=x[::9].shape)
    index = spark.createDataFrame(pd.DataFrame({"media_hash": np.arange(len(x)), "embedding": x.tolist()}))
    asked = spark.createDataFrame(pd.DataFrame({"query_id": np.arange(len(q)), "embedding": q.tolist()}))
    got = {}
    for r in similarity.nearest(asked, index, 5, floor).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.media_hash)
    assert got == brute(q, x, 5, floor)


def test_nearest_refuses_a_floor_that_skips_nothing(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0])], "media_hash string, embedding array<float>")
    with pytest.raises(ValueError):
        similarity.nearest(rows.withColumnRenamed("media_hash", "query_id"), rows, 5, 0.5)


def test_nearest_small_case_and_probes(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.8, 0.6, 0.0]), ("c", [0.0, 1.0, 0.0])], "media_hash string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.media_hash for r in similarity.nearest(q, index, 5, 0.75).orderBy("rank").collect()] == ["a", "b"]
    assert [r.media_hash for r in similarity.nearest(q, index, 5, 0.75, probe_cells=1).orderBy("rank").collect()][:1] == ["a"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], None)], "a array<float>, b array<float>, c array<float>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    (r,) = df.select(vectors.cosine(a, a), vectors.cosine(a, b), vectors.cosine(a, c), vectors.l2_normalise(a), vectors.l2_normalise(b),
                     vectors.hash_to_hex(F.lit(-1).cast("long")), vectors.hex_to_hash(F.lit("ffffffffffffffff"))).collect()
    assert tuple(r)[:3] == (1.0, 0.0, None) and r[3] == pytest.approx([0.6, 0.8]) and r[4] == [0.0, 0.0]
    assert r[5] == "f" * 16 and r[6] == -1


def test_insert_if_absent(spark):
    rows = [("h1", 0, 1, 2, [0.1234567, 1.0], "query", ""), ("h1", 1, 9, 9, None, "query", "x"), ("h2", 0, 1, 2, None, "sighting", "u" * 600), ("h3", 0, 1, 2, None, "q", None)]
    new = sinks.new_signatures(
        spark.createDataFrame(rows, "media_hash string, pos int, phash long, dhash long, embedding array<double>, source string, ref_url string"),
        spark.createDataFrame([("h3",)], "media_hash string"), F.current_timestamp(), "m")
    got = {r.media_hash: r for r in new.collect()}
    assert set(got) == {"h1", "h2"} and got["h1"].embedding[0] == pytest.approx(0.123457, abs=1e-9) and got["h1"].dim == 2
    assert got["h1"].ref_url is None and len(got["h2"].ref_url) == 600 and got["h2"].model is None


# -------------------------------------------------------------------------------------- verdicts

CMP = "inv_id string, page string, pos int, image_url string, from_engine boolean, distance int, similarity double, same_scene boolean, inliers int"


def arbitrate(spark, rows, checks=None):
    df = spark.createDataFrame([("i", "p", n, f"u{n}", *r) for n, r in enumerate(rows)], CMP)
    (r,) = verdicts.arbitrate(df, checks_after_claim=checks).collect()
    return r.verdict, r.match_kind


@pytest.mark.parametrize("rows,want", [
    ([(False, 3, None, None, None)], ("confirmed", "exact")),
    ([(False, 30, .93, None, 20)], ("confirmed", "variant")),
    ([(False, 30, .93, False, 12)], ("ambiguous", None)),
    ([(False, 30, .80, None, 20)], ("ambiguous", None)),
    ([(False, 30, .80, False, 20)], ("rejected", None)),
    ([(False, 30, .50, None, None)], ("rejected", None)),
    ([(False, 30, None, None, None)], ("unverified", None)),
    ([(False, 20, None, True, 60)], ("confirmed", "variant")),
    ([(True, 3, None, None, None), (False, 40, .2, False, 5)], ("ambiguous", None)),
    ([(True, 3, None, None, None), (False, 40, .2, None, 5)], ("confirmed", "exact")),
    ([(True, 3, None, None, None), (False, 40, .2, True, 50)], ("confirmed", "variant")),
    ([(True, 3, None, None, None)] + [(False, 40, .2, False, 5)] * 3 + [(False, 2, None, None, None)], ("confirmed", "exact")),
])
def test_arbitration(spark, rows, want):
    assert arbitrate(spark, rows) == want


def test_arbitration_with_a_budget_of_checks(spark):
    rows = [(True, 3, None, None, None)] + [(False, 40, .2, False, 5)] * 3 + [(False, 2, None, None, None)]
    assert arbitrate(spark, rows, 3) == ("ambiguous", None)


def test_page_evidence_levels(spark):
    schema = "inv_id string, page string, level string, pos int, image_url string, width int, height int, distance int, same_scene boolean, inliers int, frame int"
    rows = [
        ("i", "a", "platform", 1, "pa", 10, 20, 30, None, 0, 0), ("i", "a", "page", 1, "pg", 11, 21, 5, None, 0, 0),
        ("i", "b", "page", 1, "x", 1, 1, 40, False, 3, 0), ("i", "b", "engine_claim", 1, "t", 1, 1, 2, None, 0, 0),
        ("i", "c", "engine_claim", 1, "t", 7, 8, 30, True, 44, 1), ("i", "d", "engine_claim", 3, "late", 7, 8, 1, None, 0, 0), ("i", "d", "page", 1, "z", 7, 8, 30, None, 0, 0),
    ]
    got = {r.page: r.image for r in verdicts.page_image_evidence(spark.createDataFrame(rows, schema), 2).collect()}
    assert (got["a"].level, got["a"].kind, got["a"].checked, got["a"].width) == ("page", "exact", 2, 11)
    assert (got["b"].level, got["b"].note, got["b"].checked) == ("none", "page images differ", 1)
    assert (got["c"].level, got["c"].kind, got["c"].inliers, got["c"].frame, got["c"].note) == ("engine_claim", "variant", 44, 1, "page not checkable")
    assert (got["d"].level, got["d"].checked) == ("none", 1)


# -------------------------------------------------------------------------------------- pictures

def png(rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_undecodable_pictures(spark, tmp_path):
    (tmp_path / "big.png").write_bytes(png(np.zeros((24, 32, 3), np.uint8)))
    (tmp_path / "junk.png").write_bytes(b"not a picture")
    pics, files = tables.read_images(spark, str(tmp_path)), tables.read_bytes(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in tables.undecodable(files, pics).collect()] == ["junk.png"]
    assert files.filter("media_hash is null").count() == 0


def keyframes_by_hand(frames, k):
    feats = [(n, p & (2**64 - 1), s) for n, p, std, s in frames if std >= 12 and s >= 25]
    if not feats:
        return set(range(min(k, len(frames))))
    n = len(frames)
    first = max([f for f in feats if n // 3 <= f[0] <= 2 * n // 3] or feats, key=lambda f: f[2])
    chosen = [first] + [f for f in feats if f[0] == 0 and first[0] != 0 and k > 1]
    while len(chosen) < k:
        best = max((f for f in feats if f[0] not in {c[0] for c in chosen}), key=lambda f: (min((f[1] ^ c[1]).bit_count() for c in chosen), -f[0]), default=None)
        if best is None or min((best[1] ^ c[1]).bit_count() for c in chosen) < 6:
            break
        chosen.append(best)
    return {c[0] for c in chosen}


def test_keyframes_equal_sequential_rule(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for v in range(12):
        base = rng.integers(-(1 << 62), 1 << 62, 6)
        frames = [(n, int(base[rng.integers(0, 6)] ^ (1 << int(rng.integers(0, 60)))), float(rng.choice([5, 30])), float(rng.choice([10, 40, 50, 60]))) for n in range(int(rng.integers(1, 30)))]
        rows += [(f"v{v}", *f) for f in frames]
        want[f"v{v}"] = keyframes_by_hand(frames, 5)
    got = {}
    for r in images.select_keyframes(spark.createDataFrame(rows, "video_id string, frame_no int, phash long, std double, sharpness double"), 5).collect():
        got.setdefault(r.video_id, set()).add(r.frame_no)
    assert got == want


def copies_by_hand(rows):
    kept = []
    for _, _, url, ph, w, h, src, on in rows:
        for c in kept:
            if ((c[1] ^ ph) & (2**64 - 1)).bit_count() <= 4:
                if c[4] in images.UPLOAD_LIKE and src in ("page", "platform"):
                    continue
                if src in ("page", "platform") and c[4] in ("page", "platform") and w * h > c[2] * c[3]:
                    c[0], c[2], c[3] = url, w, h
                break
        else:
            kept.append([url, ph, w, h, src])
    return [tuple(c) for c in kept]


def test_copies_equal_sequential_rule(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for inv in range(20):
        mine = [(f"i{inv}", n, f"u{n}", int(rng.choice([0, 1, 7, 255, -1])) ^ int(rng.choice([0, 2])), int(rng.integers(100, 900)), int(rng.integers(100, 900)),
                 str(rng.choice(["upload", "frame", "page", "platform", "small"])), None) for n in range(25)]
        rows += mine
        want[f"i{inv}"] = copies_by_hand(mine)
    schema = "inv_id string, pos int, url string, phash long, width int, height int, source string, found_on string"
    got = {}
    for r in images.dedupe_copies(spark.createDataFrame(rows, schema)).orderBy("inv_id", "id").collect():
        got.setdefault(r.inv_id, []).append((r.url, r.phash, r.width, r.height, r.source))
    assert got == want


def test_many_copies_of_one_investigation(spark):
    """Thousands of pictures that resemble no other, with a few that do: only the few are walked together."""
    rng = np.random.default_rng(5)
    hashes = [int(h) for h in rng.integers(-2**63, 2**63 - 1, 3000)]
    hashes += [h ^ 9 for h in hashes[:40]] + hashes[20:60]
    rows = [("i", n, f"u{n}", h, 100 + n % 700, 300, str(rng.choice(["upload", "page", "platform"])), None) for n, h in enumerate(hashes)]
    schema = "inv_id string, pos int, url string, phash long, width int, height int, source string, found_on string"
    df = spark.createDataFrame(rows, schema)
    got = [(r.url, r.phash, r.width, r.height, r.source) for r in images.dedupe_copies(df).orderBy("id").collect()]
    assert got == copies_by_hand(rows)


def test_unsearched_order(spark):
    rows = [("i", 1, "http://u/1", 1000, 800, "upload", []), ("i", 2, "http://p/2", 736, 552, "page", []), ("i", 3, "https://pbs.twimg.com/3", 900, 900, "platform", []),
            ("i", 4, "http://p/4", 200, 200, "page", []), ("i", 5, "http://p/5", 2000, 2000, "page", ["e"])]
    c = spark.createDataFrame(rows, "inv_id string, id int, url string, width int, height int, source string, searched array<string>")
    assert [r.id for r in images.unsearched_copies(c, "e", 5).orderBy("search_rank").collect()] == [3, 1, 2]


# -------------------------------------------------------------------------------------- file metadata

def test_file_report(spark):
    xmp = (b'\xff\xd8<x:xmpmeta><rdf:RDF><rdf:Description xmp:CreatorTool="Midjourney v6" photoshop:Credit="Reut\xc3\xa9rs"/><dc:creator><rdf:Seq>'
           b"<rdf:li>Jane</rdf:li></rdf:Seq></dc:creator></rdf:RDF></x:xmpmeta>")
    signed_file = b"jumb....c2pa....claim_generator\x00\x10Adobe Firefly 2.0\x00c2pa.actions xx trainedAlgorithmicMedia"
    none = None
    rows = [(1, xmp, "Adobe Photoshop", none, "Canon", "EOS R5", none, none, "human", 0.05, none),
            (2, signed_file, none, none, none, none, "AP", none, "ai", 0.93, "dalle"), (3, b"plain", none, none, none, none, none, none, none, none, none)]
    df = spark.createDataFrame(rows, "id int, content binary, exif_software string, exif_artist string, exif_make string, exif_model string, iptc_credit string, "
                                     "iptc_creator string, ai_verdict string, ai_confidence double, ai_generator string")
    got = {r.id: r for r in forensics.file_report(df).collect()}
    assert got[1].xmp.credit == "Reutérs" and got[1].xmp.creator == "Jane" and got[1].likely_ai
    assert "software: Adobe Photoshop / Midjourney v6" in got[1].hints and "camera: Canon EOS R5" in got[1].hints
    assert got[2].c2pa.present and got[2].c2pa.claim_generator.startswith("Adobe Firefly") and got[2].c2pa.digital_source_type
    assert "AI-generated per detector (93%), generator guess dalle" in got[2].hints
    assert got[3].hints == [] and not got[3].likely_ai and not got[3].c2pa.present


def test_file_report_reads_whole_blocks(spark):
    kind = b"trainedAlgorithmicMedia"
    contents = {
        "long": b"jumb c2pa claim_generator\x00\x10" + b"Studio " * 20 + b"9.1\x00c2pa.actions" + b"edited " * 200 + kind,
        "nul": b"jumb c2pa c2pa.actions\x00\x01\x02" + kind,
        "reference": b"jumb c2pa claim self#jumbf=c2pa.assertions/c2pa.actions\x00" + b"\x01" * 900 + b"c2pa.actions\x00" + b"y" * 900 + kind,
        "before": b"jumb c2pa " + kind + b" c2pa.actions c2pa.opened",
        "none": b"jumb c2pa " + kind,
        "late name": b'<x:xmpmeta><rdf:Description xmp:CreatorTool="' + b"Plug-in, " * 40 + b'Midjourney"/></x:xmpmeta>',
    }
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "id string, content binary").select("*", *[none.alias(c) for c in (
        "exif_software", "exif_artist", "exif_make", "exif_model", "iptc_credit", "iptc_creator", "ai_verdict", "ai_generator")], F.lit(None).cast("double").alias("ai_confidence"))
    got = {r.id: r for r in forensics.file_report(df).collect()}
    assert {k: r.likely_ai for k, r in got.items()} == {"long": True, "nul": True, "reference": True, "before": False, "none": False, "late name": True}
    assert got["long"].c2pa.claim_generator == "Studio " * 20 + "9.1" and got["late name"].xmp.creator_tool.endswith("Midjourney")
