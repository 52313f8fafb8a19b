"""The operators over the given tables: thin steps that map tables to the operators' records and results back."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    exact_dedup, extraction, hard_negatives, host_rules, language, mixing, near_dup, quality_fm, token_counts, toxicity, url_filter, vector_codes, word_bpe,
)

# ---------------------------------------------------------------------------------------- Fixed values
LINK_WORDS, LINK_SIMILARITY = 4, Fraction(85, 100)
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
MIX_EVENNESS = 0.5        # half of the way from the natural mixture's entropy to that of equal weights
BLOCK_TOKENS = 1_000_000
# ---------------------------------------------------------------------------------------------------


def analyses(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text_content"))


def results(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("domain"), F.col("text").alias("snippet"), F.col("lang").alias("language"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    """Of a null id: false."""
    return F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedupe_texts(analyses(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("media_hash").alias("text_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(analyses(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = word_bpe.decode_texts(word_bpe.encode_texts(analyses(table(spark, sf_dir, "documents")), path), path)
    return out.select(
        F.col("id").alias("doc_id"), (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded_text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(table(spark, sf_dir, "documents")).select("id", "domain", mixing.word_count(F.col("snippet")).alias("n_tokens"))
    out = mixing.mix_results(rows, most_repetition=None, evenness=MIX_EVENNESS, block_tokens=BLOCK_TOKENS)
    return out.select(F.col("id").alias("doc_id"), F.col("domain").alias("source"), "n_tokens", "epoch", "block", "key")


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).filter(~held_out())
    out = quality_fm.score_quality(rows, quality_fm.fit_quality(rows, labels))
    return out.select(F.col("id").alias("doc_id"), held_out().alias("held_out"), "score", "predicted")


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge_results(results(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(table(spark, sf_dir, "documents"))
    out = language.identify(rows, language.fit_languages(rows.filter(~held_out())))
    return out.select(F.col("id").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(analyses(table(spark, sf_dir, "documents")), words=LINK_WORDS, at_least=LINK_SIMILARITY)
    return out.withColumnRenamed("id", "doc_id")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The url goes with the page's id through the operator.
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page_id"), "html")
    return extraction.extract_pages(pages, "page_id").select("page_id.*", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.common import join_back

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = url_filter.filter_urls(pages, RULES)
    return join_back(pages.select("page_id", "url"), judged, ["url"], "page_id").select("page_id", "host", "path", "rule", "verdict")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_hash"), "embedding", F.col("label").alias("source"))
    out = vector_codes.compress_vectors(stored)
    return out.select(F.col("media_hash").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_hash"), "embedding", origin.alias("ref_url"))
    return hard_negatives.mine_negatives(stored, F.col("media_hash") % 100 == 0)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def left_out():
        return F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False))

    rows = results(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")).filter(~left_out())
    out = toxicity.score_toxicity(rows, toxicity.fit_toxicity(rows, labels))
    return out.select(F.col("id").alias("doc_id"), left_out().alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_token_counts, op3_word_bpe, op4_temperature_mix, op5_quality_fm, op6_host_rules, op7_language_id, op8_jaccard_join,
        op9_main_text, op10_url_filter, op11_vector_codes, op12_hard_negatives, op13_toxicity,
    )
}

def _codes_sql() -> str:
    """Every round in SQL: all parts against all entries, in exact integers that doubles hold."""
    steps = ["""
        WITH k AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
          SELECT vec_id, label, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS v FROM k, range(4) AS t(part)
        ), c0 AS (
          SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v
          FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)
        )"""]
    for r in range(5):
        steps.append(f"""a{r} AS (
          SELECT vec_id, p.part, arg_min(entry, (list_dot_product(c.v, c.v) - 2 * list_dot_product(p.v, c.v)) * 256 + entry) AS entry
          FROM p JOIN c{r} AS c ON p.part = c.part GROUP BY vec_id, p.part
        )""")
        if r < 4:
            steps.append(f"""m{r} AS (
          SELECT part, entry, list(mean ORDER BY i) AS v FROM (
            SELECT part, entry, i, floor(sum(v[i]) / count(*)) AS mean
            FROM p JOIN a{r} USING (vec_id, part), unnest(range(1, len(v) + 1)) AS t(i) GROUP BY part, entry, i
          ) GROUP BY part, entry
        ), c{r + 1} AS (
          SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN m{r} AS m USING (part, entry)
        )""")
    return ", ".join(steps) + """, e AS (
          SELECT p.vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY p.part) AS code,
            sum(list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v))::BIGINT AS error
          FROM p JOIN a4 USING (vec_id, part) JOIN c4 AS c USING (part, entry) GROUP BY p.vec_id
        ), d AS (
          SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
          FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c4)
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, d
    """


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op4_temperature_mix": rf"""
        WITH RECURSIVE t AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
        ), s AS (
          SELECT source, sum(n_tokens)::BIGINT AS total FROM t GROUP BY source HAVING sum(n_tokens) > 0
        ), p AS (
          SELECT source, total, total / (SELECT sum(total)::DOUBLE FROM s) AS share FROM s
        ), h AS (
          SELECT -sum(share * ln(share)) + {MIX_EVENNESS} * (ln(count(*)) + sum(share * ln(share))) AS target FROM p
        ), steps AS (
          SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
          UNION ALL
          SELECT i + 1, CASE WHEN entropy < target THEN low ELSE middle END, CASE WHEN entropy < target THEN middle ELSE high END
          FROM (SELECT i, low, high, (low + high) / 2 AS middle,
                  ln(sum(pow(share, (low + high) / 2))) - (low + high) / 2 * sum(pow(share, (low + high) / 2) * ln(share)) / sum(pow(share, (low + high) / 2)) AS entropy
                FROM steps, p WHERE i < 24 GROUP BY i, low, high), h
        ), e AS (
          SELECT CASE WHEN (SELECT -sum(share * ln(share)) < target FROM p, h GROUP BY target) THEN floor(max(low) * 1e6) / 1e6 ELSE 1 END AS a FROM steps
        ), q AS (
          SELECT source, total, pow(share, a) AS p FROM p, e
        ), z AS (
          SELECT sum(p) AS z, max(total / p) AS most FROM q
        ), m AS (
          SELECT source, total, p / z AS weight, round(p / z * (most * z))::BIGINT AS quota FROM q, z
        ), r AS (
          SELECT doc_id, t.source, n_tokens, total, weight, quota, unnest(range(ceil(quota / total)::BIGINT))::INTEGER AS epoch
          FROM t JOIN m ON t.source IS NOT DISTINCT FROM m.source WHERE n_tokens > 0
        ), k AS (
          SELECT *, md5('1:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM r
        ), b AS (
          SELECT *, epoch * total + coalesce(sum(n_tokens) OVER (
            PARTITION BY source, epoch ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM k
        )
        SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, epoch, floor(begun / (weight * {float(BLOCK_TOKENS)}))::BIGINT AS block, key FROM b WHERE begun < quota
    """,
    "op10_url_filter": r"""
        WITH u AS (
          SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages
        ), r AS (
          SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
            ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(verdict, rule_host, rule_path)
        ), f AS (
          SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
          FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)
    """,
    "op11_vector_codes": _codes_sql(),
    "op12_hard_negatives": """
        WITH r AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS origin, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.origin = b.origin AS same, list_dot_product(a.x, b.x)::BIGINT AS score
          FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
          SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
    """,
}
