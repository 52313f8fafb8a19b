"""From documents to token ids: language, exact and near duplicates, mixture, encoding. Each stage is written and reread."""

from __future__ import annotations

import uuid
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm import exact_dedup, language, mixing, near_dup, word_bpe
from sightline.llm.common import settle
from sightline.llm.queries import analyses, held_out, results
from sightline.session import shared_folder

# ---------------------------------------------------------------------------------------- Fixed values
LEAST_SCORE = 0.5            # posterior probability below which a language is rejected
SHINGLE_WORDS, SIMILARITY = 5, Fraction(4, 5)
EVENNESS = 0.5               # half of the way from the natural mixture's entropy to that of equal weights
# ---------------------------------------------------------------------------------------------------




def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without a letter, undecided ones and those of languages not learned go."""
    rows = results(docs)
    model = language.fit_languages(rows.filter(~held_out()))
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("id"), F.col("text").alias("snippet"))
    told = language.identify(packed, model, keep_text=True)
    told = told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("margin") >= 0))
    return told.select("id.*", F.col("snippet").alias("text")).select(*docs.columns)


def once(docs: DataFrame) -> DataFrame:
    """The documents without rows that repeat another's ``doc_id`` and text (A-Z read as a-z); of such rows, the least by
    text, language and source stays. Only rows whose id comes more than once are grouped."""
    twice = settle(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("twice")))
    same = docs["doc_id"].eqNullSafe(twice["twice"])
    again = docs.join(twice, same, "left_semi")
    order = Window.partitionBy("doc_id", F.sha2(exact_dedup.folded(F.col("text")), 256)).orderBy("text", "lang", "source", "n_chars")
    again = again.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return docs.join(twice, same, "left_anti").unionByName(again)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id; of rows that repeat it, one."""
    told = settle(exact_dedup.dedupe_texts(analyses(docs)).select("id", "kept", "media_hash"))
    twice = told.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.coalesce("kept", F.lit(True))).alias("some")).filter("n > 1 and some").select("id")
    twice = settle(twice)
    # What goes is named by its id, or, where an id comes with several texts, by id and text.
    gone = told.filter(~F.coalesce("kept", F.lit(True)))
    alone = settle(gone.join(twice, gone["id"].eqNullSafe(twice["id"]), "left_anti").select(F.col("id").alias("gone_id")))
    texts = settle(gone.join(twice, gone["id"].eqNullSafe(twice["id"]), "left_semi").select(F.col("id").alias("gone_id"), F.col("media_hash").alias("gone_text")))
    left = docs.join(alone, docs["doc_id"].eqNullSafe(alone["gone_id"]), "left_anti")
    own = F.sha2(exact_dedup.folded(docs["text"]), 256)
    return once(left.join(texts, docs["doc_id"].eqNullSafe(texts["gone_id"]) & (own == texts["gone_text"]), "left_anti"))


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id, and one of rows that repeat it; all
    without a doc_id."""
    groups = near_dup.near_duplicates(analyses(docs), words=SHINGLE_WORDS, at_least=SIMILARITY)
    gone = settle(groups.filter("component_id <> id").select(F.col("id").alias("gone_id")).distinct())
    return once(docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of rare sources more often, by the mixture's permutations."""
    rows = results(docs)
    plan = mixing.mix_results(rows.select("id", "domain", mixing.word_count(F.col("snippet")).alias("n_tokens")), most_repetition=None, evenness=EVENNESS)
    return mixing.copies(docs, plan, id="doc_id", domain="source", text="text")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, token_ids`` of every document of the mixture."""
    packed = docs.select(F.struct("doc_id", "source").alias("id"), F.col("text").alias("text_content"))
    return word_bpe.encode_texts(packed, public_tokenizers.path("word_bpe_49k.json")).select("id.*", "n_tokens", "token_ids")


STAGES = [
    ("language_id", identified),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_enough),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: A fitted model, an exact similarity join and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
