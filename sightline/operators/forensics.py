"""What the file itself says: embedded metadata, credentials, hints. Native over ``binaryFile`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import blank_to_null, let, strip

# --- Fixed values ----------------------------------------------------------------------------------
XMP_FIELDS = (
    ("creator_tool", r'(?is)xmp:CreatorTool(?:="([^"]+)"|>\s*([^<]+)<)'),
    ("credit", r'(?is)photoshop:Credit(?:="([^"]+)"|>\s*([^<]+)<)'),
    ("source", r'(?is)photoshop:Source(?:="([^"]+)"|>\s*([^<]+)<)'),
    ("creator", r"(?is)dc:creator>.*?<rdf:li[^>]*>\s*([^<]+)<"),
    ("rights", r"(?is)dc:rights>.*?<rdf:li[^>]*>\s*([^<]+)<"),
    ("description", r"(?is)dc:description>.*?<rdf:li[^>]*>\s*([^<]+)<"),
    ("history_software", r'(?is)stEvt:softwareAgent(?:="([^"]+)"|>\s*([^<]+)<)'),
    ("digital_source_type", r'(?is)DigitalSourceType(?:="([^"]+)"|>\s*([^<]+)<)'),
)
GENERATOR_NAMES = (
    "midjourney", "dall", "stable diffusion", "firefly", "openai", "gemini", "imagen", "leonardo", "ideogram",
    "flux", "trainedalgorithmicmedia",
)
DETECTOR_SURE = 0.7
ALGORITHMIC = "trainedAlgorithmicMedia"
MAGIC = (
    ("^89504E470D0A1A0A", "image/png", ".png"), ("^FFD8", "image/jpeg", ".jpg"),
    ("^474946383[79]61", "image/gif", ".gif"), ("^52494646.{8}57454250", "image/webp", ".webp"),
)
# ---------------------------------------------------------------------------------------------------


def _clean(text: Column) -> Column:
    """One captured byte run as text: re-read as UTF-8, stripped, whole."""
    utf8 = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    return blank_to_null(strip(F.trim(strip(utf8), F.lit("\u0000"))))


def xmp_summary(content: Column) -> Column:
    """The eight embedded XMP fields as a struct; each null when absent."""
    def read(raw):
        at = F.greatest(
            F.instr(raw, "<x:xmpmeta"),
            F.when(F.instr(raw, "<x:xmpmeta") == 0, F.instr(raw, "<rdf:RDF")).otherwise(0),
        )
        return let(F.when(at > 0, F.substring(raw, at, F.length(raw))), lambda chunk: F.struct(*[
            _clean(F.coalesce(*[
                blank_to_null(F.regexp_extract(chunk, p, i)) for i in ((1, 2) if "|" in p else (1,))
            ])).alias(name) for name, p in XMP_FIELDS
        ]))

    return let(F.decode(content, "ISO-8859-1"), read)


def credentials_summary(content: Column) -> Column:
    """``struct<present, claim_generator, digital_source_type>`` of signed content credentials.

    The source type counts wherever it stands from the first mention of the actions to the end of the file: the
    claim's reference to the actions may come before their block, and a block has any length.
    """
    def read(raw):
        labelled = F.contains(raw, F.lit("c2pa"))
        mentioned = labelled | F.contains(raw, F.lit("contentauth"))
        generator = F.regexp_extract(raw, r"claim_generator[^A-Za-z0-9]{1,8}([A-Za-z0-9 ._/()-]{3,})", 1)
        at = F.instr(raw, "c2pa.actions")
        actions = F.when(at > 0, F.substring(raw, at, F.length(raw)))
        return F.struct(
            (mentioned & (labelled | F.contains(raw, F.lit("jumb")))).alias("present"),
            F.when(mentioned, _clean(generator)).alias("claim_generator"),
            F.when(mentioned & F.contains(actions, F.lit(ALGORITHMIC)), ALGORITHMIC).alias("digital_source_type"),
        )

    return let(F.decode(content, "ISO-8859-1"), read)


def sniff(content: Column) -> Column:
    """``struct<mime, extension>`` from the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    mime = ext = None
    for pattern, m, e in MAGIC:
        test = head.rlike(pattern)
        mime = F.when(test, m) if mime is None else mime.when(test, m)
        ext = F.when(test, e) if ext is None else ext.when(test, e)
    return F.struct(mime.otherwise("application/octet-stream").alias("mime"), ext.otherwise("").alias("extension"))


def inline_image(text: Column) -> Column:
    """Bytes of a base64 string or an image data URL."""
    return F.unbase64(F.when(
        text.startswith("data:image"), F.regexp_replace(text, r"^data:image/[^;]+;base64,", "")
    ).otherwise(text))


def file_report(files: DataFrame) -> DataFrame:
    """Adds ``xmp, c2pa, hints, likely_ai``.

    ``files``: ``content``, already extracted tag columns ``exif_software, exif_artist, exif_make,
    exif_model, iptc_credit, iptc_creator``, and the detector's ``ai_verdict, ai_confidence,
    ai_generator`` (null where there is none).
    """
    f = files.withColumns({"xmp": xmp_summary(F.col("content")), "c2pa": credentials_summary(F.col("content"))})
    named = F.array_distinct(F.array_compact(F.array(
        blank_to_null(F.col("exif_software")), F.col("xmp.creator_tool"), F.col("xmp.history_software")
    )))
    f = f.withColumns({
        "_software": blank_to_null(F.array_join(named, " / ")),
        "_credit": F.coalesce(blank_to_null(F.col("iptc_credit")), F.col("xmp.credit")),
        "_creator": F.coalesce(blank_to_null(F.col("iptc_creator")), F.col("xmp.creator"), blank_to_null(F.col("exif_artist"))),
    })
    generator = F.coalesce(F.lower("_software").rlike("|".join(GENERATOR_NAMES)), F.lit(False))
    declared = F.col("xmp.digital_source_type").isNotNull() | F.col("c2pa.digital_source_type").isNotNull()
    sure = F.coalesce((F.col("ai_verdict") == "ai") & (F.col("ai_confidence") >= DETECTOR_SURE), F.lit(False))
    camera = strip(F.concat(
        F.lit("camera: "), F.coalesce("exif_make", F.lit("")), F.lit(" "), F.coalesce("exif_model", F.lit(""))
    ))
    hints = F.array_compact(F.array(
        F.concat(F.lit("credit line in file: "), F.col("_credit")),
        F.concat(F.lit("creator in file: "), F.col("_creator")),
        F.when(F.coalesce(blank_to_null(F.col("exif_make")), blank_to_null(F.col("exif_model"))).isNotNull(), camera),
        F.concat(F.lit("software: "), F.col("_software")),
        F.when(generator, "software field names an AI image generator"),
        F.when(F.col("c2pa.present"), F.concat(
            F.lit("C2PA content credentials present"),
            F.coalesce(F.concat(F.lit(" ("), F.col("c2pa.claim_generator"), F.lit(")")), F.lit("")),
        )),
        F.when(declared, "declared as algorithmically generated media"),
        F.when(sure, F.concat(
            F.lit("AI-generated per detector ("), F.floor(F.col("ai_confidence") * 100).cast("string"), F.lit("%)"),
            F.coalesce(F.concat(F.lit(", generator guess "), blank_to_null(F.col("ai_generator"))), F.lit("")),
        )),
    ))
    return f.withColumns({"hints": hints, "likely_ai": sure | declared | generator}).drop("_software", "_credit", "_creator")
