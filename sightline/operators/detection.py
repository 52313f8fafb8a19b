"""AI-detection reports, text annotations, and answers reused by content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import SPACES, blank_to_null, let, strip
from sightline.operators.skew import salted_join

# --- Fixed values ----------------------------------------------------------------------------------
AI_LABEL = "منشأة بواسطة الذكاء الاصطناعي"
REAL_LABEL = "الصورة حقيقية (غير منشأة بالذكاء الاصطناعي)"
UNKNOWN_LABEL = "لا يمكن تحديد مصدر الصورة"
TEXT_AI_LABEL, TEXT_HUMAN_LABEL = "نص مُولّد بالذكاء الاصطناعي", "نص بشري (غير مُولّد بالذكاء الاصطناعي)"
MIN_TEXT = 250
FLAG_SCORE = 0.5
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif")
AUDIO_EXTENSIONS = ("mp3", "wav", "ogg", "m4a", "flac", "aac", "wma")
REPORT_MIMES = ("application/pdf", "application/json", "text/csv")
# ---------------------------------------------------------------------------------------------------


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def text_hash(text: Column) -> Column:
    """Hash of the stripped text (Unicode white space counts as blank)."""
    bare = F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")
    return F.sha2(F.encode(bare, "UTF-8"), 256)


def image_report(body: Column) -> Column:
    """Image report JSON to ``struct<verdict, ai_confidence, human_confidence, generator,
    generator_confidence>``; the generator is the key with the highest confidence, first key on ties."""
    def read(v):
        report = "$.report.ai_generated"
        # An object left by JSON order; a confidence is a number or an object that holds one.
        generators = F.from_json(F.get_json_object(body, f"{report}.generator"), "map<string,string>")
        pairs = F.transform(F.map_entries(generators), lambda e, i: F.struct(
            F.coalesce(
                F.when(e["value"].startswith("{"), F.get_json_object(e["value"], "$.confidence")).otherwise(e["value"])
                .try_cast("double"), F.lit(0.0)
            ).alias("confidence"), (-i).alias("neg_place"), e["key"].alias("name"),
        ))
        best = F.array_max(F.filter(pairs, lambda p: p["confidence"] > 0))
        found = F.coalesce(F.size(F.try_variant_get(v, report, "map<string,variant>")) > 0, F.lit(False))
        verdict = F.lower(F.try_variant_get(v, f"{report}.verdict", "string"))
        return let(best, lambda b: F.struct(
            F.when(~found, "unknown").when(verdict == "ai", "ai").otherwise("human").alias("verdict"),
            F.when(~found, 0.0).otherwise(F.coalesce(F.try_variant_get(v, f"{report}.ai.confidence", "double"), F.lit(0.0))).alias("ai_confidence"),
            F.when(~found, 1.0).otherwise(F.coalesce(F.try_variant_get(v, f"{report}.human.confidence", "double"), F.lit(0.0))).alias("human_confidence"),
            F.when(found, F.coalesce(b["name"], F.lit("unknown"))).otherwise("unknown").alias("generator"),
            F.when(found, F.coalesce(b["confidence"], F.lit(0.0))).otherwise(0.0).alias("generator_confidence"),
        ))

    return let(F.try_parse_json(body), read)


def score_report(body: Column) -> Column:
    """A single generated-image score, clamped; above one half is "ai"."""
    score = F.get_json_object(body, "$.type.ai_generated").try_cast("double")
    return let(clamp(score), lambda ai: F.struct(
        F.when(ai > 0.5, "ai").otherwise("human").alias("verdict"), ai.alias("ai_confidence"),
        clamp(1.0 - ai).alias("human_confidence"), F.lit("unknown").alias("generator"),
    ))


def text_report(body: Column) -> Column:
    """Text report: the human share is taken before clamping."""
    at = "$.report.ai_text"
    detected = F.coalesce(F.get_json_object(body, f"{at}.is_detected").try_cast("boolean"), F.lit(False))
    raw = F.coalesce(F.get_json_object(body, f"{at}.confidence").try_cast("double"), F.lit(0.0))
    return F.struct(
        detected.alias("is_ai"), clamp(raw).alias("ai_confidence"), clamp(1.0 - raw).alias("human_confidence"),
        F.when(detected, TEXT_AI_LABEL).otherwise(TEXT_HUMAN_LABEL).alias("verdict"),
    )


def annotations(body: Column) -> Column:
    """``array<struct<text, confidence, is_ai>>`` from ``[[text, score], ...]``; a bad score counts 0."""
    blocks = F.from_json(F.get_json_object(body, "$.report.ai_text.annotations"), "array<array<string>>")
    return F.transform(F.filter(blocks, lambda b: F.size(b) >= 2), lambda b: let(
        clamp(F.coalesce(F.get(b, F.lit(1)).try_cast("double"), F.lit(0.0))),
        lambda s: F.struct(strip(F.get(b, F.lit(0))).alias("text"), s.alias("confidence"), (s >= FLAG_SCORE).alias("is_ai")),
    ))


def flagged_share(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flagged blocks of all blocks per text. ``blocks``: keys and ``is_ai``."""
    return blocks.groupBy(*keys).agg(
        F.count_if("is_ai").alias("flagged"), F.count(F.lit(1)).alias("blocks"),
        (F.count_if("is_ai") / F.count(F.lit(1))).alias("share"),
    )


def media_verdict(body: Column, kind: str) -> Column:
    """Audio and video reports: ``struct<is_ai, confidence>`` with defaults."""
    at = "$.report" if kind == "audio" else "$.report.ai_video"
    return F.struct(
        (F.lower(F.coalesce(F.get_json_object(body, f"{at}.verdict"), F.lit("unknown"))) == "ai").alias("is_ai"),
        F.coalesce(F.get_json_object(body, f"{at}.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
    )


def long_enough(text: Column, minimum: int = MIN_TEXT) -> Column:
    return F.length(F.trim(text, F.lit(SPACES))) >= minimum


def verdict_label(verdict: Column) -> Column:
    return F.when(verdict == "unknown", UNKNOWN_LABEL).when(verdict == "ai", AI_LABEL).otherwise(REAL_LABEL)


def analysis_rows(results: DataFrame) -> DataFrame:
    """Detection results as stored analyses. ``results`` may lack some of the alternative columns."""
    def pick(*names):
        there = [F.col(n) for n in names if n in results.columns]
        return F.coalesce(*there) if there else F.lit(None)

    return results.withColumns({
        "is_ai_generated": pick("is_ai", "is_ai_generated").cast("boolean"),
        "confidence_ai": pick("confidence_ai", "confidence").cast("double"),
        "confidence_human": pick("confidence_human").cast("double"),
        "verdict": blank_to_null(F.coalesce("verdict", F.lit(""))),
        "generator": blank_to_null(F.coalesce("generator", F.lit(""))),
    })


# --------------------------------------------------------------------------------- answers by hash

def latest_by(rows: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; combines map-side, so a picture asked for very often is no hot group."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select(*keys, "_r.*")


def newest_answers(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest stored answer of each key. ``answers``: keys, ``id, created_at, mode, has_payload``."""
    return latest_by(answers, keys, "created_at", "id").select(
        *keys, F.col("id").alias("_id"), F.coalesce("mode", F.lit("deep")).alias("_mode"), F.col("has_payload").alias("_full")
    )


def serve(joined: DataFrame) -> DataFrame:
    """Requests joined to their newest answer: ``answer_id`` is set when that answer may be reused.

    A forced request never reuses one, nor does one without a hash, and a quick answer never serves a deep
    request: the newest answer decides, an older deep one is not searched for.
    """
    fits = F.col("_full") & ~F.coalesce("force", F.lit(False)) & ~((F.col("mode") == "deep") & (F.col("_mode") != "deep"))
    return joined.withColumn("answer_id", F.when(fits, F.col("_id"))).drop("_id", "_mode", "_full")


def split_by_cache(requests: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``answer_id`` to each request; null marks the work list."""
    spread = [c for c in requests.columns if c not in keys]
    return serve(salted_join(requests, newest_answers(answers, keys), list(keys), "left", spread=spread))


# --------------------------------------------------------------------------------------- text rules

def needs_translation(text: Column) -> Column:
    return F.coalesce(
        (F.length(text) >= 3) & text.rlike(r"\p{L}") & ~text.rlike(r"[؀-ۿ]"), F.lit(False)
    )


def tidy_identity(
    people: Column, queries_ar: Column, queries_en: Column, people_kept: int | None = None, queries_kept: int | None = None,
) -> Column:
    """Lists of strings only: people, non-blank queries of each language; the first so many where a number is given."""
    def first(a, limit):
        return a if limit is None else F.slice(a, 1, limit)

    def kept(a):
        return first(F.filter(F.array_compact(a), lambda q: strip(q) != ""), queries_kept)

    return F.struct(
        first(F.array_compact(people), people_kept).alias("people"), kept(queries_ar).alias("queries_ar"),
        kept(queries_en).alias("queries_en"),
    )


def file_type(mime: Column) -> Column:
    kind = F.substring_index(mime, "/", 1)
    return F.when(kind.isin("image", "video", "audio"), kind).when(mime.isin(*REPORT_MIMES), "report").otherwise("export")


def allowed_file(name: Column, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    return F.contains(name, F.lit(".")) & F.lower(F.substring_index(name, ".", -1)).isin(*extensions)
