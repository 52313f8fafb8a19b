"""Each text operator against a brute-force rule or the library it must equal, and on awkward records."""

import collections
import hashlib
import random
import re
import struct
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sightline.llm import exact_dedup, extraction, host_rules, language, mixing, near_dup, quality_fm, token_counts, url_filter, word_bpe
from sightline.llm.common import components

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
GAP = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997} and{i}" for i in range(40_000))
#: Null, empty, blank, very long, ties that differ in case, repeated rows, specials, no white space, other scripts.
TEXTS = [None, "", " \n\t ", "Hello World again", "hello world AGAIN", "hello world again", LONG, "x" * 30_000, "<|endoftext|> a <s>", "Ελλάς Σ́", "a\x00b", "12 34.5\n\n\n6", "日本語 テキスト", None, ""]


def fold(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def analyses(spark):
    """Awkward text analyses; the other columns have names that the operators use inside."""
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], None, None, None), (None, "Hello World again", None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, text_content string, keep_id string, n int, hub string")
    return df.withColumns({c: F.lit(c) for c in ("like", "sign", "row", "key", "recipe", "media_hash", "chunk", "n_tokens")}).repartition(3)


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, f"d{i % 2}" if i % 5 else None, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(TEXTS)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, domain string, snippet string, language string")
    return df.withColumns({c: F.lit(c) for c in ("weight", "quota", "epoch", "words", "rate", "label", "last", "end", "place")})


def test_exact_duplicates(analyses):
    got = exact_dedup.dedupe_texts(analyses).collect()
    rows = [(r["id"], r["text_content"]) for r in analyses.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    want = sorted((i or -1, max(x for x in groups[fold(t)] if x is not None), len(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((r["id"] or -1, r["keep_id"], r["group_size"], r["media_hash"]) for r in got) == want
    assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)
    assert exact_dedup.dedupe_texts(analyses.filter("false")).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    a = rng.integers(97, 123, 60_000).astype(np.uint8)
    b = np.concatenate([a[:20_000], rng.integers(97, 123, 37).astype(np.uint8), a[20_000:]])
    parts = lambda t: [t[i:j].tobytes() for i, j in zip([0, *exact_dedup.cuts(t)], exact_dedup.cuts(t))]
    assert b"".join(parts(a)) == a.tobytes() and len(set(parts(a)) - set(parts(b))) <= 3
    assert exact_dedup.cuts(np.zeros(50_000, np.uint8))[-1] == 50_000 and exact_dedup.cuts(a[:0]) == []


def test_texts_whose_chunks_share_a_name_are_told_apart(spark, monkeypatch):
    """Two texts with one recipe, the chunk's name being contested."""
    rows = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA")], "id bigint, text_content string")
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("aa", "bb")}
    same = spark.createDataFrame([(1, sha["aa"], [7]), (2, sha["bb"], [7]), (3, sha["aa"], [7])], "id bigint, media_hash string, recipe array<bigint>")
    monkeypatch.setattr(exact_dedup, "chunk_recipes", lambda *a: same)
    for contested, want in ((7, {1: (3, 2), 2: (2, 1), 3: (3, 2)}), (8, {1: (3, 3), 2: (3, 3), 3: (3, 3)})):
        monkeypatch.setattr(exact_dedup, "contested_chunks", lambda *a, c=contested: spark.createDataFrame([(c,)], "chunk bigint"))
        assert {r["id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedupe_texts(rows).collect()} == want


def odd_texts():
    rng = random.Random(5)
    odd = ["<|endoftext|>", "<|startoftext|>", "  ", "\n", "'s", "'ll", "<0x0A>", "the ", " Hello", "ΑΣ", "1234", ".\n", "▁", "</w>", "½", "²."]
    for _ in range(1500):
        yield "".join(rng.choice(odd) if rng.random() < 0.4 else chr(rng.choice([rng.randint(97, 122), rng.randint(32, 0x24F), rng.randint(0x370, 0x3FF)])) for _ in range(rng.choice([1, 5, 40])))


def test_token_counts_equal_the_library(analyses):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_counts.PieceCounter(open(PIECES, "rb").read())
    assert counter.cut.pattern == token_counts.CUTS[0] and len(counter.whole) > 30_000
    texts = [*odd_texts(), LONG, "ab" * 3000]
    assert [counter.count(t) for t in texts] == [len(sp.encode(t)) for t in texts]
    for r in token_counts.count_tokens(analyses, PIECES).join(analyses.select("id", "text_content"), "id").collect():
        t = r["text_content"] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)
    assert token_counts.count_tokens(analyses.filter("false"), PIECES).count() == 0


def test_encoding_equals_the_library_and_decodes(analyses):
    from tokenizers import Tokenizer

    t, bpe = Tokenizer.from_file(WORDS), word_bpe.WordBpe(open(WORDS, "rb").read())
    for s in [*odd_texts(), "ththe" * 900, LONG]:
        e = t.encode(s, add_special_tokens=False)
        assert bpe.encode(s) == struct.pack(f"<{len(e.ids)}I", *e.ids) and bpe.decode(bpe.encode(s)) == t.decode(e.ids, skip_special_tokens=False)
    got = word_bpe.decode_texts(word_bpe.encode_texts(analyses, WORDS), WORDS).join(analyses.select("id", "text_content"), "id").collect()
    assert all(r["decoded_text"] == t.decode(t.encode(r["text_content"] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in got)
    assert word_bpe.encode_texts(analyses.filter("false"), WORDS).count() == 0


def test_mixture_keeps_its_limits(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, None).otherwise("rare").alias("domain"), (F.col("id") % 50).alias("n_tokens"))
    out = mixing.mix_results(rows, most_repetition=2.0, block_tokens=5000).toPandas()
    total, read = rows.toPandas().groupby("domain", dropna=False).n_tokens.sum(), out.groupby("domain", dropna=False).n_tokens.sum()
    assert abs(read["hot"] - total["hot"]) <= 50
    rarest = total.idxmin()
    assert 1.99 < read.reset_index(drop=True)[list(total.index).index(rarest)] / total.min() <= 2.05
    whole = out[out.block < out.block.max()].groupby("block").n_tokens.sum()
    assert ((whole - 5000).abs() <= 3 * 50).all()
    once = out.groupby(["domain", "epoch", "id"], dropna=False).size()
    assert once.max() == 1 and set(out[out.domain == "hot"].id) == {r["id"] for r in rows.filter("n_tokens > 0 and domain = 'hot'").collect()}
    entropy = mixing.mixture(rows, None, least_entropy=1.0).toPandas()
    w = entropy.weight
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-3
    assert mixing.mix_results(rows.filter("false")).count() == 0


def test_encoding_of_every_code_point():
    """Each between a letter and a digit."""
    from tokenizers import Tokenizer

    t, bpe = Tokenizer.from_file(WORDS), word_bpe.WordBpe(open(WORDS, "rb").read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for first in range(0, len(points), 64):
        run = points[first:first + 64]
        s = " ".join(f"a{chr(c)}1" for c in run)
        ids = t.encode(s, add_special_tokens=False).ids
        assert bpe.encode(s) == struct.pack(f"<{len(ids)}I", *ids), hex(run[0])


def test_the_bisected_exponent(spark):
    """Against a fine grid, on unequal shares and on those of the given table, where the target must bind."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("source as domain", "text")
    given = docs.select("domain", mixing.word_count(F.col("text")).alias("n_tokens"))
    uneven = spark.createDataFrame([("a", 700), ("b", 200), ("c", 99), (None, 1)], "domain string, n_tokens int")
    for rows in (given, uneven):
        shares = mixing.domain_shares(rows)
        p = np.array([r["share"] for r in shares.collect()])

        def entropy(a):
            w = p ** a / (p ** a).sum()
            return -(w * np.log(w)).sum()

        for evenness in (0.25, 0.5, 0.9):
            a = mixing.find_exponent(shares, evenness=evenness)
            target = entropy(1) + evenness * (np.log(len(p)) - entropy(1))
            grid = max(x for x in np.arange(0, 1.0001, 1e-3) if entropy(x) >= target)
            assert 0 < a < 1 and grid <= a + 1e-6 and a < grid + 1e-3 and entropy(a) >= target
    assert mixing.find_exponent(shares, evenness=0.0) == 1.0 and mixing.find_exponent(shares, evenness=1.0) < 0.01
    assert mixing.find_exponent(shares.filter("false"), evenness=0.5) == 1.0
    with pytest.raises(ValueError):
        mixing.find_exponent(shares, most_repetition=2.0, evenness=0.5)


def test_mixture_on_awkward_results(results):
    rows = results.withColumn("n_tokens", mixing.word_count(F.col("snippet")))
    out = mixing.mix_results(rows, most_repetition=2.0)
    assert {r["id"] for r in out.collect()} <= set(range(len(TEXTS)))
    taken = mixing.copies(results, out)
    assert taken.columns == results.columns
    want = collections.Counter(r["id"] for r in out.collect())
    assert collections.Counter(r["id"] for r in taken.collect()) == want


def test_quality_learns_words_and_pairs(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    def row(i):
        good = i % 2
        return (i, " ".join(rng.choices(words[:40] if good else words[20:], k=60)) + (". " if good else " | ||"), good)
    rows = spark.createDataFrame([row(i) for i in range(600)], "id bigint, snippet string, label int")
    model = quality_fm.fit_quality(rows, rows.filter("id % 3 <> 1"))
    got = quality_fm.score_quality(rows, model).join(rows.select("id", "label"), "id").filter("id % 3 = 1").toPandas()
    assert (got.predicted == got.label).mean() > 0.9
    x = np.random.default_rng(1).normal(size=(3, quality_fm.BUCKETS + len(quality_fm.STATISTICS))).astype(np.float32)
    v = model.factors.astype(float)
    pairs = [sum(float(v[i] @ v[j]) * x[0, i] * x[0, j] for i in range(40) for j in range(i)) for _ in (0,)]
    small = np.zeros_like(x[:1]); small[0, :40] = x[0, :40]
    assert abs(model.margin(small)[0][0] - model.bias - float(small[0] @ model.weights) - pairs[0]) < 1e-2


def test_quality_on_awkward_results(results):
    labels = results.select("id", F.lit(1).alias("label"))
    out = quality_fm.score_quality(results, quality_fm.fit_quality(results, labels)).collect()
    assert len(out) == results.count() and all(0 <= r["score"] <= 1 for r in out)
    none = quality_fm.fit_quality(results.filter("false"), labels.filter("false"))
    assert quality_fm.score_quality(results.filter("false"), none).count() == 0 and quality_fm.score_quality(results, none).count() == results.count()


def base(t):
    w = GAP.findall(t or "")
    lines = [x for x in (t or "").split("\n") if GAP.search(x)]
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_host_rules_equal_brute_force(spark, results):
    rng = random.Random(4)
    texts = [*TEXTS, *(" ".join(rng.choices("ab", k=rng.randint(1, 60))) for _ in range(60)), "a b c d e f g a b c d e x\na b c d e\na b c d e", "| # same\nsame\n same \nsame"]
    rows = spark.createDataFrame([(i, f"h{i % 4}", t) for i, t in enumerate(texts)], "id int, domain string, snippet string").withColumn("words", F.lit(1))
    for r in host_rules.measure(rows).collect():
        b = base(texts[r["id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0])
    assert host_rules.judge_results(results).count() == results.count() and host_rules.judge_results(results.filter("false")).count() == 0


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "x y"
    rows = spark.range(1010).select("id", F.when(F.col("id") < 500, "farm").when(F.col("id") < 1005, "news").otherwise("tiny").alias("domain"),
                                    F.when((F.col("id") < 450) | (F.col("id") == 1005), bad).otherwise(good).alias("snippet"))
    out = {d: (k, n) for d, k, n in host_rules.judge_results(rows).groupBy("domain").agg(F.count_if("kept"), F.count("*")).collect()}
    assert out == {"farm": (0, 500), "news": (505, 505), "tiny": (4, 5)}


def test_languages(spark, results):
    words = {"en": "the and of that with this from have not are", "de": "der die und nicht mit ein auch sich über für", "fr": "le les des une dans pour être avec nous ça"}
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, lang, " ".join(rng.choices(w.split(), k=30))) for i in range(90) for lang, w in words.items()], "id bigint, language string, snippet string")
    model = language.fit_languages(rows.filter("id % 3 <> 1"))
    asked = rows.filter("id % 3 = 1").select(F.struct("id", "language").alias("id"), "snippet")
    assert model.languages == ["de", "en", "fr"] and all(r["id"]["language"] == r["lang_pred"] for r in language.identify(asked, model).collect())
    out = {r["id"]: r for r in language.identify(results, model).collect() if r["id"] is not None}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[11]["lang_pred"] == "und" and out[0]["score"] == 0 and out[12]["lang_pred"] != "und"
    none = language.fit_languages(results.filter("false"))
    assert {r["lang_pred"] for r in language.identify(results, none).collect()} == {"und"} and language.identify(results.filter("false"), model).count() == 0
    found, at = language.bucket_runs(["abc", "abcabc"])
    assert list(found[:6]) == list(language.bucket_runs(["abc"])[0][:6]) and list(at) == [0, 15, 39]


def linked(rows, size, at_least):
    sets = {}
    for i, t in rows:
        w = GAP.findall(fold(t))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    def root(i):
        while least[i] != i:
            i = least[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= at_least:
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("size", "at_least"), [(4, Fraction(85, 100)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_near_duplicates_equal_brute_force(spark, size, at_least, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 16)
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, n = [(i, t) for i, t in enumerate(TEXTS) if t != LONG], 100
    for _ in range(8):  # families whose members drift apart, and chains
        words = rng.choices(vocabulary, k=rng.choice([5, 12, 60, 150]))
        for _ in range(30):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = w
            rows.append((n, " ".join(w)))
            n += 1
    df = spark.createDataFrame(rows, "id bigint, text_content string").repartition(4)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, words=size, at_least=at_least).collect()}
    assert got == linked(rows, size, at_least)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(8)
    scheme = near_dup.PartEnum(Fraction(85, 100))
    for _ in range(400):
        common, a, b = int(rng.integers(1, 400)), int(rng.integers(0, 40)), int(rng.integers(0, 40))
        f = rng.integers(0, 2**64, common + a + b, np.uint64)
        if common * 100 >= 85 * (common + a + b):
            assert np.intersect1d(scheme.signatures(f[:common + a]), scheme.signatures(np.concatenate([f[:common], f[common + a:]]))).size


def test_members_of_light_signatures_stay_apart(spark):
    """Rows that share an empty part with a hub are not members of all that the hub has in common with others."""
    groups = {11: [1, 2, 3], 20: [1, 4, 5], 31: [1, 6], 41: list(range(1, 60)), 50: [7, 8], 61: [9]}
    df = spark.createDataFrame([(s, i) for s, ids in groups.items() for i in ids], "sign long, id long")
    for rows in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = {}
            for r in near_dup._stars(df.repartition(1).sortWithinPartitions("sign")).collect():
                got.setdefault((r.hub, r.sign), set()).add(r.id)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        hubs = {s: {h for h, t in got if t == s} for s in (11, 41)}
        assert {s: len(h) for s, h in hubs.items()} == {11: 1, 41: 1}
        assert all(got[h, s] | {h} == set(groups[s]) for s in hubs for h in hubs[s])
        heavy = set().union(*({h} | ids for (h, t), ids in got.items() if not t))
        assert {4, 5, 7, 8} <= heavy and not heavy & ({9} | set(range(10, 60)))


def test_likely_pairs_by_levels():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(base[:top], size)) for size, top in zip(rng.integers(20, 900, 120), rng.choice([30, 300, 4000], 120))]
    sets += [s[rng.random(len(s)) < 0.9] for s in sets] + [np.repeat(base[:1], 1), np.arange(0, 256 * 40, 256, dtype=np.uint64)]
    held = near_dup.profiles(pa.array([near_dup.fold(s) for s in sets]), "fold")
    n = np.array(list(map(len, sets)))
    for at_least in (Fraction(4, 5), Fraction(1, 2), Fraction(99, 100)):
        want = [(i, j) for i in range(100) for j in np.flatnonzero(near_dup.may_link(held[i], held, n[i], n, at_least))]
        assert sorted(zip(*near_dup.likely_pairs(held[:100], held, n[:100], n, at_least))) == want and want


def test_near_duplicates_on_awkward_analyses(spark, analyses):
    out = near_dup.near_duplicates(analyses).collect()
    assert len(out) == analyses.count() and {r["component_id"] for r in out if r["id"] in (3, 4, 5)} == {3}
    assert all(r["component_id"] == r["id"] for r in out if r["n_shingles"] == 0)
    names = analyses.withColumn("id", F.concat(F.lit("u"), "id"))
    assert {r["component_id"] for r in near_dup.near_duplicates(names).collect() if r["id"] in ("u3", "u4", "u5")} == {"u3"}
    assert near_dup.near_duplicates(analyses.filter("false")).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain, hub = [(i, i + 1) for i in range(0, 60)], [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*chain, *hub, (7, 7)], "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href="/">Home</a> Site</header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies.</div><article><header><h1>Big &amp; small</h1></header>
<p>First&nbsp;<b>bold</b>
 text<br>goes on &#233;.<p>Short.<div class="ad">Buy now, of the best</div><blockquote>Said <a href="x">one</a> of many.</blockquote>
<section id="comments"><p>Nice article, the best of all that I have read.</p></section><form>Name <input></form></article>
<aside>Related</aside><footer>&copy; me</footer><script>var a = "</p><p>no";</script>"""


def test_main_text():
    assert extraction.main_text(PAGE) == "Big & small\nFirst bold text goes on é.\nShort.\nSaid one of many."
    plain = "<div>Home</div><div><p>" + "It is the story of a man who was in the city and had all that he would have. " * 5 + "</p><p>Then.</p><p>" + "There was more of it in the house than they could have known of. " * 5 + "</p></div><div><a href=x>next page of links</a></div><p>" + "zzz " * 60
    got = extraction.main_text(plain).split("\n")
    assert len(got) == 3 and got[1] == "Then."
    for broken in ("<", "<a", "<p", "a < b", "<div class='x", "<!-- never", "<script>x", "</div></p>", "<a<a<a" * 2000, '<p a="' * 2000, "&am", "<article>x &amp y"):
        extraction.main_text(broken)
    assert extraction.main_text("<article>1 < 2 &lt; 3</article>") == "1 < 2 < 3"


def test_articles_in_wrappers_are_kept():
    story = '<article><h1><a href="/p">A linked title</a></h1><p>Body of it.</p><p><a href="/q">All of this is a link.</a></p><div class="social-share">Tweet</div></article>'
    want = "A linked title\nBody of it.\nAll of this is a link."
    for wrapper in ('<div class="layout has-sidebar">', '<div id="page" class="social-share-on">', '<form id="aspnet">', '<div class="banner">', "<section class='no-ads'><div>"):
        assert extraction.main_text(f"<body class=has-sidebar>{wrapper}{story}") == want, wrapper
    for beside in ("<aside>", "<nav>", '<div id="comments">', '<ol class="comment-list"><li>', '<div role="complementary">', "<div hidden>", '<div class="related">'):
        assert extraction.main_text(f"{story}{beside}<article><p>Not of it.</p></article>") == want, beside
        assert extraction.main_text(story.replace("</article>", f"{beside}<article><p>Not of it.</p></article></div>")) == want, beside
    for name in ("ad", "ad-300x250", "cookie-notice", "sidebar", "ads1", "nav-bar"):
        assert extraction.main_text(f'<article>Text.<div class="x {name}">Not of it.</div></article>') == "Text.", name
    assert extraction.main_text('<article>Text.<div class="has-sidebar">And of it.</div></article>') == "Text.\nAnd of it."


def test_no_text_is_lost_behind_odd_elements():
    good = {
        "<article><p>A.</p><svg class='i'/><p>B.</p></article>": "A.\nB.", "<article><p>A.</p><iframe src='x'/><p>B.</p></article>": "A.\nB.",
        "<article><p>A.</p><video-player><p>x</p></video-player><p>B.</p></article>": "A.\nx\nB.", "<article><p>A.</p><button>z<p>B.</p></article>": "A.\nz\nB.",
        "<article><p>A <math><mi>x</mi></math>.</p></article>": "A x.", "<head><title>x</title><article>Q.</article>": "Q.",
        "<article><p>A.<svg><g><title>t</title><path/></g></svg> B.</p><video><p>fallback</p></video>C<select><option>1</select>D</article>": "A. B.\nCD",
        "<article><p>A.</p><object><p>x</article><p>no</p></object>": "A.", "<article><title-bar>A</title-bar> <mapping>B</mapping></article>": "A B",
        "<article>A.<script src=x></script>B<script>if (a</p>b) '</article>'</script>C</article>": "A.BC",
    }
    for page, want in good.items():
        assert extraction.main_text(page) == want, page
    for name in ("user-comments", "reader-comments", "site-notice", "ad_unit", "advert-slot", "cookie-banner-v2"):
        assert extraction.main_text(f"<article>Text.<div class='{name}'>Not of it.</div></article>") == "Text.", name
    assert extraction.main_text("<article>Text.</article><article class='comment'><p>Not of it.</p></article>") == "Text."


def test_other_languages_and_links_around_blocks():
    for sentence in ("Сегодня хорошая погода и мы идем гулять в парк с детьми. ", "今日はとても良い天気ですね。公園に行きましょう。みんなで遊びます。"):
        page = f"<div class=nav>а б</div><div><h1>Заг</h1><p>{sentence * 9}</p></div><div class=footer>в</div>"
        assert extraction.main_text(page).split("\n")[-1] == (sentence * 9).strip()
    prose = "It is the story of a man who was in the city and had all that he would have. " * 4
    assert extraction.main_text(f"<p>{prose}</p><a href=x><div>{prose.upper()}</div></a>") == prose.strip()


def slow_text(page):
    """A second reader, on the library's parser, of pages whose text lies in one article with marked holders beside it."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.text, self.stack = [], [], []

        def end(self):
            joined = " ".join("".join(self.text).split())
            if joined and "article" in self.stack and not {"nav", "footer", "aside", "ad"} & set(self.stack):
                self.blocks.append(joined)
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag in ("br",):
                self.text.append(" ")
            elif tag in extraction.BLOCKS:
                self.end()
                self.stack.append("ad" if dict(attrs).get("class") == "ad" else tag)

        def handle_endtag(self, tag):
            if tag in extraction.BLOCKS:
                self.end()
                names = ["div" if s == "ad" else s for s in self.stack]
                if tag in names:
                    del self.stack[len(names) - 1 - names[::-1].index(tag):]

        def handle_data(self, data):
            if self.cdata_elem is None:
                self.text.append(data)

    reader = Reader()
    reader.feed(re.sub(r"(?s)<title>.*?</title>", "", page))
    reader.end()
    return "\n".join(reader.blocks)


def test_pages_equal_a_second_reader_and_rules_decide():
    import duckdb

    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    whole = kept = 0
    for page in pages:
        text = extraction.main_text(page)
        assert text == slow_text(page)
        # The same page without the tag that names its article: the rules alone.
        bare = extraction.main_text(page.replace("<article", "<div").replace("</article>", "</div>"))
        assert bare or not text
        lines = set(bare.split("\n"))
        whole, kept = whole + len(text), kept + sum(len(x) for x in text.split("\n") if x in lines)
    assert kept >= 0.97 * whole
    labels = collections.Counter(b.label for page in pages for b in extraction.blocks_of(page) if not b.marked)
    assert labels["good"] and labels["near"] and labels["short"]


def test_pages_on_awkward_rows(spark):
    rows = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, PAGE, "t"), (3, PAGE, "t"), (None, "<main>x</main>", "t")], "page_id int, html string, text string")
    out = extraction.extract_pages(rows).collect()
    assert sorted(r["n_blocks"] for r in out) == [0, 0, 1, 4, 4] and extraction.extract_pages(rows.filter("false")).count() == 0


RULES = [("allow", "com", "/"), ("block", "bad.example.com", "/x/"), ("allow", "www.bad.example.com", "/x/")]


def test_urls_and_their_aliases(spark):
    link = '<html><head><LINK href="%s" rel="Canonical"></head>'
    rows = [
        ("http://bad.example.com/x/1", ""), ("http://alias.org/a?x#top", link % "http://bad.example.com/x/1"),
        ("http://alias.net/b", '<meta http-equiv=refresh content="0; url=http://ALIAS.org/a?x">'), ("http://www.bad.example.com/x/2", link % "http://bad.example.com/x/1"),
        ("http://other.org/", link % "/self"), ("http://only.org/", link % "http://bad.example.com/x/never-landed"), ("no scheme", None), (None, None), (None, ""), ("HTTP://M.Bad.Example.COM?q", ""),
        ("http://hop.org/", ""),
    ]
    pages = spark.createDataFrame(rows, "url string, html string").withColumns({c: F.lit(c) for c in ("node", "host", "rule", "component", "tag")})
    redirects = spark.createDataFrame([("http://hop.org/", "http://alias.net/b"), (None, "x")], "url string, target string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, RULES, redirects).collect()}
    assert got == {
        "http://bad.example.com/x/1": ("bad.example.com", "/x/1", "bad.example.com/x/", "block"), "http://alias.org/a?x#top": ("alias.org", "/a", None, "block"),
        "http://alias.net/b": ("alias.net", "/b", None, "block"), "http://www.bad.example.com/x/2": ("www.bad.example.com", "/x/2", "www.bad.example.com/x/", "allow"),
        "http://other.org/": ("other.org", "/", None, "allow"), "http://only.org/": ("only.org", "/", None, "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "HTTP://M.Bad.Example.COM?q": ("m.bad.example.com", "", None, "allow"), "http://hop.org/": ("hop.org", "/", None, "block"),
    }
    assert url_filter.filter_urls(pages.filter("false"), RULES).count() == 0
