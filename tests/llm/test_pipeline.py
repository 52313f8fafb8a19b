"""The pipeline's stages on the smallest tables, each against a brute-force rule."""

import collections
import os

import pytest
from fractions import Fraction
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from sightline.llm import queries
from tests.llm.test_operators import fold, linked

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("cast(90001 as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    seen = [docs.unionByName(extra)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    rows = [[r.asDict() for r in s.collect()] for s in seen]
    ids = [[r["doc_id"] for r in s] for s in rows]
    assert sorted(ids[1]) == sorted(i for i in ids[0] if i != 90001)
    last = {}
    for r in rows[1]:
        last[fold(r["text"])] = max(r["doc_id"], last.get(fold(r["text"]), -1))
    assert sorted(ids[2]) == sorted(last.values())
    least = linked([(r["doc_id"], r["text"]) for r in rows[2]], 5, Fraction(4, 5))
    assert sorted(ids[3]) == sorted(i for i, (_, c) in least.items() if c == i)
    assert set(ids[4]) == set(ids[3]) and max(collections.Counter(ids[4]).values()) <= 2
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in rows[0]}
    assert sorted(ids[5]) == sorted(ids[4]) and all(r["n_tokens"] == len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in rows[5])
    for s in seen[1:5]:
        assert s.columns == docs.columns
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_repeated_rows_and_ids(spark):
    """Rows that repeat id and text, ids with several texts, null ids, texts and sources."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"the word{i} of it" for i in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (1, long.upper(), None), (2, long, "b"), (3, "the one and only of it", "a"), (3, "the other and the one more of it", "a"),
            (3, "THE one and only of it", "b"), (4, "the other and the one more of it", None), (None, "the text without a name", "a"), (None, "the text without a name", "b"), (5, None, "a"), (5, "", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("doc_id", "text", "cast('en' as string) lang", "source", "length(text) n_chars")
    df = df.select(*[df[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    got = corpus_pipeline.distinct_texts(spark, df, SF).collect()
    assert got and sorted((r["doc_id"] or -1, fold(r["text"])) for r in got) == sorted([
        (2, long), (3, "the one and only of it"), (4, "the other and the one more of it"), (-1, "the text without a name"), (5, "")])
    near = spark.createDataFrame([(1, long), (1, long), (2, long + " more"), (7, "the end of it all and of us"), (7, "the end of it all and of us"), (None, long)], "doc_id bigint, text string")
    near = near.selectExpr("doc_id", "text", "cast('en' as string) lang", "cast(null as string) source", "length(text) n_chars")
    near = near.select(*[near[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    got = corpus_pipeline.distinct_enough(spark, near, SF).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == [-1, 1, 7]
    mixed = corpus_pipeline.mixed(spark, near, SF).collect()
    assert {r["doc_id"] for r in mixed} == {1, 2, 7, None}


def test_languages_not_learned_go(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    foreign = ["Bugün hava çok güzel ve herkes çocuklarla oynamak için parka gidiyor. ", "Tänään on kaunis päivä ja kaikki menevät puistoon leikkimään lasten kanssa. ",
               "Dzisiaj jest piękny dzień i wszyscy idą do parku, gdzie będą się bawić z dziećmi. ", "Сегодня хорошая погода, и мы идем гулять в парк с детьми. ", "今日はとても良い天気ですね。公園に行きましょう。"]
    clean = ["Hello", "The cat sat on the mat.", "Das ist gut", "ok", "and the 2353820953013749 4550997810720808 of 19.37.233.111", "THE AND!! OF!! THE!! THAT!! IS!!"]
    rows = [(90000 + i, t) for i, t in enumerate([*foreign, *(t * 40 for t in foreign), *clean])]
    extra = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'x' source", "length(text) n_chars")
    both = docs.unionByName(extra.select(*[extra[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))
    kept = {r["doc_id"] for r in corpus_pipeline.identified(spark, both, SF).select("doc_id").collect()}
    assert {i for i, _ in rows} & kept == {90000 + len(foreign) * 2 + i for i in range(len(clean))}
    assert docs.count() == len(kept) - len(clean)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)] and len(corpus_pipeline.STAGES) == 5
