"""Reading landed HTML with native expressions: whole tags are cut out first, then attributes are read
inside a tag, so attribute order does not matter. No parser, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions import dates, urls
from sightline.functions.columns import SPACES, blank_to_null, first_nonblank, let, strip

# --- Fixed values: where a page states its date, with the trust each place gets -----------------------
# (tag, attribute, value, evidence name, confidence)
META_DATES = (
    ("meta", "property", "article:published_time", "meta:article:published_time", 0.95),
    ("meta", "property", "og:published_time", "meta:og:published_time", 0.85),
    ("meta", "property", "article:published", "meta:article:published", 0.85),
    ("meta", "name", "parsely-pub-date", "meta:parsely-pub-date", 0.85),
    ("meta", "name", "pubdate", "meta:pubdate", 0.80),
    ("meta", "name", "publishdate", "meta:publishdate", 0.80),
    ("meta", "name", "publish-date", "meta:publish-date", 0.80),
    ("meta", "name", "article.published", "meta:article.published", 0.80),
    ("meta", "itemprop", "datePublished", "meta:datePublished", 0.80),
    ("meta", "name", "dc.date.issued", "meta:dc.date.issued", 0.80),
    ("meta", "name", "DC.date.issued", "meta:dc.date.issued", 0.80),
    ("meta", "name", "sailthru.date", "meta:sailthru.date", 0.75),
    ("meta", "name", "date", "meta:date", 0.70),
    ("time", "datetime pubdate", None, "time:pubdate", 0.80),
    ("time", "itemprop", "datePublished", "time:datePublished", 0.80),
    ("time", "datetime", None, "time:datetime", 0.65),
    ("*", "itemprop", "datePublished", "itemprop:datePublished", 0.65),
)
JSONLD_DATES = (("datePublished", 0.90), ("dateCreated", 0.85), ("uploadDate", 0.90))
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
TEXT_DATE_PATTERNS = (
    r"(?i)\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})",
    r"(?i)\b(\d{4}-\d{2}-\d{2})\b",
    rf"(?i)\b(\d{{1,2}}\s+(?:{MONTHS})\s+(?:19|20)\d{{2}})\b",
    rf"(?i)\b((?:{MONTHS})\s+\d{{1,2}},\s+(?:19|20)\d{{2}})\b",
)
TEXT_DATE_CONFIDENCE = 0.45
MIN_IMAGE_SIDE = 100
SOCIAL_IMAGE_KEYS = ("og:image", "og:image:url", "twitter:image", "twitter:image:src")
# ------------------------------------------------------------------------------------------------------

ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
)
_JSONLD = r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"
_STYLES_AND_SCRIPTS = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def attribute(tag: Column, name: str) -> Column:
    """Attribute value inside one tag; '' when present without a value, null when absent."""
    raw = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)

    def value(v):
        bare = F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return F.when(v != "", F.when(v.contains("&"), unescape(bare)).otherwise(bare)).when(
            tag.rlike(rf"(?is)\s{name}(?=[\s=/>])"), F.lit(""))

    return let(raw, value)


def without_code(html: Column) -> Column:
    """The document without comments, scripts and style sheets."""
    return F.regexp_replace(html, _STYLES_AND_SCRIPTS, " ")


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^<]*)"), F.lit(1))


def visible_text(html: Column, stripped: bool = False) -> Column:
    """Text of a document, each piece stripped, joined by one space."""
    body = html if stripped else without_code(html)
    pieces = F.transform(F.split(body, "<[^>]*>"), lambda p: F.trim(p, F.lit(SPACES)))
    return unescape(F.array_join(F.filter(pieces, lambda p: p != ""), " "))


def meta_content(html: Column, key: str, attributes=("property",)) -> Column:
    """``content`` of the first meta tag whose key attribute has this value."""
    def has_key(tag):
        test = attribute(tag, attributes[0]) == key
        for other in attributes[1:]:
            test = test | (attribute(tag, other) == key)
        return F.coalesce(test, F.lit(False))

    first = F.get(F.filter(tags(html, "meta"), has_key), F.lit(0))
    return attribute(first, "content")


def title_tag(html: Column) -> Column:
    return strip(unescape(F.regexp_extract(html, r"(?is)<title\b[^>]*>([^<]*)", 1)))


def title(html: Column, fallback: Column) -> Column:
    """og:title, else the title tag, else the fallback."""
    found = let(without_code(html), lambda body: first_nonblank(
        strip(meta_content(body, "og:title")), title_tag(body)))
    return F.coalesce(found, fallback)


def caption(html: Column) -> Column:
    """og:description, else the description, else the body text."""
    def read(body):
        stated = F.coalesce(
            meta_content(body, "og:description"), meta_content(body, "description", ("name",)), F.lit(""))
        shown = F.regexp_replace(body, r"(?is)<(nav|footer|header)\b.*?</\1\s*>", " ")
        return first_nonblank(stated, F.regexp_replace(visible_text(shown, stripped=True), r"\s+", " "))

    return F.coalesce(let(without_code(html), read), F.lit(""))


def title_v1(html: Column, url: Column) -> Column:
    """Earlier order: the title tag, then og:title, then the network location."""
    found = let(without_code(html), lambda body: first_nonblank(
        title_tag(body), strip(meta_content(body, "og:title"))))
    return F.coalesce(found, urls.netloc_of(url))


# ------------------------------------------------------------------------------------- JSON-LD

def jsonld_bodies(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_JSONLD), F.lit(1))


def _variant_items(v: Column) -> Column:
    """The elements of a JSON array, or the value itself as the only element."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _jsonld_parsed(html: Column) -> Column:
    return F.filter(F.transform(jsonld_bodies(html), lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())


def jsonld_objects(html: Column) -> Column:
    """The top-level JSON-LD objects of a page; a ``@graph`` stays closed."""
    return F.flatten(F.transform(_jsonld_parsed(html), _variant_items))


def jsonld_items(html: Column) -> Column:
    """Every JSON-LD value of a page, arrays and ``@graph`` lists opened at whatever depth they lie.

    Each step opens what the step before has found. A level lies in a bracket of its own, so there are as many steps as
    brackets are nested in the bodies.
    """
    none = F.array().cast("array<variant>")

    def lists_in(v):
        return F.coalesce(
            F.try_variant_get(v, "$['@graph']", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), none)

    def step(state, _):
        items = F.flatten(F.transform(state["open"], _variant_items))
        deeper = let(items, lambda seen: F.struct(
            F.flatten(F.transform(seen, lists_in)).alias("open"), F.concat(state["found"], seen).alias("found")))
        return F.when(F.size(state["open"]) == 0, state).otherwise(deeper)

    # What strings hold is no bracket.
    bare = F.regexp_replace(F.array_join(jsonld_bodies(html), " "), r'"(?:[^"\\]|\\.)*+"', "")
    nested = F.aggregate(
        F.regexp_extract_all(bare, F.lit(r"([\[\]])"), F.lit(1)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda d, b: let(F.greatest(d["now"] + F.when(b == "[", 1).otherwise(-1), F.lit(0)), lambda now: F.struct(
            now.alias("now"), F.greatest(d["most"], now).alias("most"))))
    levels = nested["most"] + 1
    start = F.struct(_jsonld_parsed(html).alias("open"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), levels), start, step, lambda state: state["found"])


def _read_stated(stated: Column, as_of: Column) -> Column:
    """``array<evidence>`` from ``array<struct<stated, confidence, source>>``: one reader for all places."""
    return F.array_compact(F.transform(
        F.filter(stated, lambda s: s["stated"].isNotNull()),
        lambda s: dates.evidence(dates.parse_date(s["stated"], as_of), s["confidence"], s["source"]),
    ))


def jsonld_date_evidence(html: Column, as_of: Column) -> Column:
    """``array<evidence>`` of the dates JSON-LD objects state. Nothing is parsed on a page without any."""
    def of_item(item):
        return F.array(*[
            F.struct(F.try_variant_get(item, f"$.{key}", "string").alias("stated"), F.lit(conf).alias("confidence"),
                     F.lit(f"jsonld:{key}").alias("source"))
            for key, conf in JSONLD_DATES
        ])

    none = F.array().cast(f"array<{dates.EVIDENCE}>")
    found = F.array_distinct(_read_stated(F.flatten(F.transform(jsonld_items(html), of_item)), as_of))
    return F.when(html.contains("application/ld+json"), found).otherwise(none)


# ------------------------------------------------------------------------------ tags that carry dates

def _stated(tag: Column, text: Column) -> Column:
    return F.coalesce(
        blank_to_null(attribute(tag, "content")), blank_to_null(attribute(tag, "datetime")), blank_to_null(text)
    )


def _date_rules() -> Column:
    """Lookup from "tag|attribute|value" to the rule's place, name and confidence."""
    entries = []
    for no, (tag, attr, value, name, conf) in enumerate(META_DATES):
        entries += [F.lit(f"{tag}|{attr}|{value or ''}"), F.struct(
            F.lit(no).alias("no"), F.lit(name).alias("name"), F.lit(conf).alias("confidence"))]
    return F.create_map(*entries)


def tag_date_evidence(html: Column, as_of: Column) -> Column:
    """``array<evidence>``: the first element of each place a page may state its date.

    One pass cuts out the tags; those that mention no date are dropped before any attribute is read, and
    the rest find their rules by lookup, so the work follows the few tags that matter.
    """
    carriers = F.regexp_extract_all(
        without_code(html),
        F.lit(r"(?is)(<(?:meta|time)\b[^<]*|<[a-z][a-z0-9]*\s[^<>]*itemprop[^<]*)"), F.lit(1),
    )

    def described(t):
        tag = F.lower(F.regexp_extract(t, r"^<([A-Za-z0-9]+)", 1))

        def read(a):
            keys = F.array_compact(F.array(
                F.concat(a["tag"], F.lit("|property|"), a["property"]), F.concat(a["tag"], F.lit("|name|"), a["name"]),
                F.concat(a["tag"], F.lit("|itemprop|"), a["itemprop"]), F.concat(F.lit("*|itemprop|"), a["itemprop"]),
                F.when(a["datetime"].isNotNull(), F.concat(a["tag"], F.lit("|datetime|"))),
                F.when(a["datetime"].isNotNull() & t.rlike(r"(?is)^<[^>]*\spubdate(?=[\s=/>])"),
                       F.concat(a["tag"], F.lit("|datetime pubdate|"))),
            ))
            stated = F.coalesce(
                blank_to_null(attribute(t, "content")), blank_to_null(a["datetime"]), F.regexp_extract(t, r"(?s)>(.*)$", 1))
            rules = F.array_compact(F.transform(keys, lambda k: F.try_element_at(_date_rules(), k)))
            return F.when(F.size(rules) > 0, F.struct(stated.alias("stated"), rules.alias("rules")))

        return let(F.struct(tag.alias("tag"), *[
            attribute(t, name).alias(name) for name in ("property", "name", "itemprop", "datetime")
        ]), read)

    def first_of_each(found):
        hits = F.array_sort(F.flatten(F.transform(found, lambda d, i: F.transform(d["rules"], lambda r: F.struct(
            r["no"].alias("no"), i.alias("i"), d["stated"].alias("stated"), r["confidence"].alias("confidence"),
            r["name"].alias("source"),
        )))))
        firsts = let(hits, lambda h: F.filter(h, lambda x, j: (j == 0) | (F.get(h, j - 1)["no"] != x["no"])))
        return _read_stated(firsts, as_of)

    none = F.array().cast(f"array<{dates.EVIDENCE}>")
    dated = F.filter(carriers, lambda t: t.rlike("(?i)publish|date"))
    return let(dated, lambda tags_: F.when(
        F.size(tags_) > 0, first_of_each(F.array_compact(F.transform(tags_, described)))).otherwise(none))


def text_date_evidence(html: Column, as_of: Column) -> Column:
    """The first readable date in the visible text: the last resort of a page that states none."""
    def search(text):
        seen = F.array(*[F.regexp_replace(F.regexp_extract(text, p, 1), r"\s+", " ") for p in TEXT_DATE_PATTERNS])
        return F.get(F.array_compact(F.transform(
            F.filter(seen, lambda s: s != ""), lambda s: dates.parse_date(s, as_of))), F.lit(0))

    date = let(visible_text(html), search)
    return dates.evidence(date, TEXT_DATE_CONFIDENCE, "text:pattern_match")


def html_date_evidence(html: Column, as_of: Column) -> Column:
    """All date evidence of a document: stated dates with the fresh cap, else the text fallback."""
    stated = F.transform(
        F.concat(jsonld_date_evidence(html, as_of), tag_date_evidence(html, as_of)),
        lambda e: dates.cap_fresh(e, as_of),
    )
    return let(stated, lambda found: F.when(F.size(found) > 0, found).otherwise(
        F.array_compact(F.array(text_date_evidence(html, as_of)))
    ))


# -------------------------------------------------------------------------------- candidate images

def candidate_images(html: Column, base: Column) -> Column:
    """Image links of a page in priority order: social meta tags, JSON-LD image, img tags that are not
    declared tiny. Absolute, no data links, no vector files, no repeats."""
    def contents(metas, attr, key):
        keyed = F.filter(metas, lambda t: F.coalesce(attribute(t, attr) == key, F.lit(False)))
        return F.transform(keyed, lambda t: attribute(t, "content"))

    def social(body):
        return let(tags(body, "meta"), lambda metas: F.concat(*[
            contents(metas, attr, key) for key in SOCIAL_IMAGE_KEYS for attr in ("property", "name")]))

    def json_images(item):
        listed = F.try_variant_get(item, "$.image", "array<variant>")
        one = F.array(F.try_variant_get(item, "$.image", "variant"))
        return F.transform(F.coalesce(listed, one), lambda v: F.coalesce(
            F.try_variant_get(v, "$.url", "string"),
            F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
        ))

    structured = F.when(
        html.contains("application/ld+json"), F.flatten(F.transform(jsonld_objects(html), json_images))
    ).otherwise(F.array().cast("array<string>"))

    def side(tag, name):
        raw = attribute(tag, name)
        return F.coalesce(F.regexp_replace(raw, r"(px)+$", "").try_cast("int"), F.lit(0)), raw

    def kept(tag):
        w, raw_w = side(tag, "width")
        h, raw_h = side(tag, "height")
        number = r"^\s*[+-]?\d*(px)*\s*$"
        readable = F.coalesce(raw_w, F.lit("")).rlike(number) & F.coalesce(raw_h, F.lit("")).rlike(number)
        tiny = ((w != 0) & (w < MIN_IMAGE_SIDE)) | ((h != 0) & (h < MIN_IMAGE_SIDE))
        return ~(readable & tiny)

    def shown(body):
        return F.transform(F.filter(tags(body, "img"), kept), lambda t: first_nonblank(
            attribute(t, "src"), attribute(t, "data-src"), attribute(t, "data-original")))

    found = F.filter(
        F.array_compact(let(without_code(html), lambda body: F.concat(social(body), structured, shown(body)))),
        lambda u: (u != "") & ~u.startswith("data:"),
    )
    absolute = F.transform(found, lambda u: urls.resolve_link(u, base))
    return F.array_distinct(
        F.filter(absolute, lambda u: u.startswith("http") & ~F.lower(urls.path_of(u)).endswith(".svg"))
    )
