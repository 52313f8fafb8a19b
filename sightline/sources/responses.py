"""Landed service responses to match rows. Each function takes ``inv_id, engine, copy_id, body`` rows and
returns match rows whose ``pos`` keeps the order inside the response.

Bodies are read as variants: one malformed element never costs the rest of its response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import dates, html as H, urls
from sightline.functions.columns import blank_to_null, first_nonblank, let, strip

# --- Fixed values ----------------------------------------------------------------------------------
NO_RESULTS_MARK = "hasn't returned any results"
TINEYE_IMAGE = r"(?i)\.(jpe?g|png|webp|gif|avif)(\?|$)"
OWN_ANSWER_HOST = "x.ai"
POSTER_SIZES = ("high", "medium", "default")
# ---------------------------------------------------------------------------------------------------

_ITEMS = "array<variant>"
_KEYS = ("inv_id", "engine", "copy_id")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, _ITEMS), F.array().cast(_ITEMS))


def _parsed(responses: DataFrame) -> DataFrame:
    return responses.withColumn("v", F.try_parse_json("body"))


def _match(link, title=None, thumbnail=None, image_url=None, match_type=None, **extra) -> Column:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    fields = {"link": link, "title": title, "thumbnail": thumbnail, "image_url": image_url, "match_type": match_type}
    fields.update({k: extra.get(k) for k in ("date", "crawl_date", "first_indexed", "score", "snippet")})
    return F.struct(*[col(v).alias(k) for k, v in fields.items()])


def _explode(parsed: DataFrame, matches: Column) -> DataFrame:
    rows = parsed.select(*[c for c in _KEYS if c in parsed.columns], F.posexplode(matches).alias("pos", "m"))
    return rows.select(*[c for c in rows.columns if c != "m"], "m.*").filter(F.coalesce("link", F.lit("")) != "")


def response_status(responses: DataFrame) -> DataFrame:
    """``status`` of each answer: refused when the service says it has no results, error on a bad status."""
    error = F.get_json_object("body", "$.error")
    return responses.withColumn("status", F.when(F.col("status") != 200, "error").when(
        F.coalesce(F.contains(error, F.lit(NO_RESULTS_MARK)), F.lit(False)), "refused"
    ).otherwise("ok"))


def lens_matches(responses: DataFrame) -> DataFrame:
    """Exact and visual sections only; rows without a link drop; text results are never picture matches."""
    def of(section, label):
        return F.transform(_list(F.col("v"), f"$.{section}"), lambda i: _match(
            _text(i, "$.link"), _text(i, "$.title"), first_nonblank(_text(i, "$.thumbnail"), _text(i, "$.image")),
            blank_to_null(_text(i, "$.image")), label, date=blank_to_null(_text(i, "$.date")),
        ))

    return _explode(_parsed(responses), F.concat(of("exact_matches", "exact"), of("visual_matches", "similar")))


def matching_pages(responses: DataFrame) -> DataFrame:
    """Pages that include matching images; the link must be http."""
    found = F.transform(_list(F.col("v"), "$.image_results"), lambda i: _match(
        _text(i, "$.link"), F.coalesce(_text(i, "$.title"), F.lit("")), _text(i, "$.thumbnail"),
        blank_to_null(_text(i, "$.thumbnail")), "page_match",
    ))
    return _explode(_parsed(responses), found).filter(F.col("link").startswith("http"))


def text_results(responses: DataFrame) -> DataFrame:
    found = F.transform(_list(F.col("v"), "$.organic_results"), lambda i: _match(
        _text(i, "$.link"), F.coalesce(_text(i, "$.title"), F.lit("")), match_type="text",
        date=_text(i, "$.date"), snippet=F.coalesce(_text(i, "$.snippet"), F.lit("")),
    ))
    return _explode(_parsed(responses), found)


def recorded_pages(responses: DataFrame) -> DataFrame:
    """The recorded ``reverse_image_results.organic`` shape: title, link and description."""
    found = F.transform(_list(F.col("v"), "$.reverse_image_results.organic"), lambda i: _match(
        _text(i, "$.url"), _text(i, "$.title"), match_type="page_match", snippet=_text(i, "$.description"),
    ))
    return _explode(_parsed(responses), found)


def _first_url(item: Column, *names: str) -> Column:
    """The first http link among fields that hold a link or an object with one."""
    def http(c):
        return F.when(c.startswith("http"), c)

    return F.coalesce(*[
        http(_text(item, path)) for n in names for path in (f"$.{n}", f"$.{n}.link", f"$.{n}.url", f"$.{n}.source")
    ])


def yandex_matches(responses: DataFrame) -> DataFrame:
    """Four sections, all visual matches by construction; links back to the engine drop from one of them."""
    def of(section, links, thumbs, label):
        return F.transform(_list(F.col("v"), f"$.{section}"), lambda i: _match(
            _first_url(i, *links), F.coalesce(_text(i, "$.title"), F.lit("")), _first_url(i, *thumbs), None, label,
        ))

    own = F.filter(
        of("similar_images", ("link", "source"), ("image", "thumbnail"), "similar"),
        lambda m: ~F.coalesce(F.contains(urls.netloc_of(m["link"]), F.lit("yandex.")), F.lit(False)),
    )
    return _explode(_parsed(responses), F.concat(
        of("image_results", ("link", "source", "original_image"), ("thumbnail", "original_image"), "similar"), own,
        of("sites", ("link", "url"), ("thumbnail", "image"), "page_match"),
        of("pages_with_matching_images", ("link", "url"), ("thumbnail", "image"), "page_match"),
    ))


def tineye_matches(responses: DataFrame) -> DataFrame:
    """Matches times backlinks, each with its crawl date, the match's score and the image found there."""
    v = F.col("v")
    results = F.coalesce(F.try_variant_get(v, "$.results", "variant"), v)
    rows = F.flatten(F.transform(_list(results, "$.matches"), lambda m: F.transform(_list(m, "$.backlinks"), lambda b: _match(
        first_nonblank(_text(b, "$.backlink"), _text(b, "$.url")), "",
        first_nonblank(_text(b, "$.url"), _text(m, "$.image_url")), first_nonblank(_text(b, "$.url"), _text(m, "$.image_url")),
        "exact", crawl_date=_text(b, "$.crawl_date"), score=_text(m, "$.score"),
    ))))
    return _explode(_parsed(responses), rows).filter(F.col("link").startswith("http"))


def vision_matches(responses: DataFrame) -> DataFrame:
    """Full matches are exact, partial ones similar, pages carry their first full, else partial, image."""
    at = "$.webDetection"

    def files(section, label):
        return F.transform(_list(F.col("v"), f"{at}.{section}"), lambda i: _match(
            _text(i, "$.url"), "", _text(i, "$.url"), None, label))

    pages = F.transform(_list(F.col("v"), f"{at}.pagesWithMatchingImages"), lambda i: _match(
        _text(i, "$.url"), F.coalesce(_text(i, "$.pageTitle"), F.lit("")),
        F.coalesce(_text(i, "$.fullMatchingImages[0].url"), _text(i, "$.partialMatchingImages[0].url")), None, "page_match",
    ))
    return _explode(_parsed(responses), F.concat(
        files("fullMatchingImages", "exact"), files("partialMatchingImages", "similar"), pages))


def youtube_videos(responses: DataFrame) -> DataFrame:
    """Video search items with the exact upload time and the best poster."""
    def item(i):
        vid = _text(i, "$.id.videoId")
        poster = F.coalesce(
            *[blank_to_null(_text(i, f"$.snippet.thumbnails.{size}.url")) for size in POSTER_SIZES],
            F.concat(F.lit("https://i.ytimg.com/vi/"), vid, F.lit("/hqdefault.jpg")),
        )
        return F.struct(
            F.concat(F.lit("https://www.youtube.com/watch?v="), blank_to_null(vid)).alias("link"),
            F.coalesce(_text(i, "$.snippet.title"), F.lit("")).alias("title"), poster.alias("thumbnail"),
            poster.alias("image_url"), F.lit("organic").alias("match_type"),
            _text(i, "$.snippet.publishedAt").alias("api_date"), F.lit("platform:youtube_api").alias("api_date_source"),
            _text(i, "$.snippet.channelTitle").alias("channel"), vid.alias("video_id"),
        )

    return _explode(_parsed(responses), F.transform(_list(F.col("v"), "$.items"), item))


def captures(responses: DataFrame) -> DataFrame:
    """Capture-list answers (``url, body``): the header row drops."""
    rows = F.from_json("body", "array<array<string>>")
    return responses.select("url", F.explode(F.slice(rows, 2, F.size(rows))).alias("r")).select(
        "url", F.get("r", F.lit(0)).alias("timestamp"), F.get("r", F.lit(1)).alias("statuscode"))


# ------------------------------------------------------------------------------- rendered result pages

def rendered_tineye(pages: DataFrame, as_of: Column) -> DataFrame:
    """Match rows of a rendered result page (``inv_id, engine, copy_id, html``)."""
    anchor = r'<a\b[^<>]*data-test="match-link"'
    blocks = F.regexp_extract_all("html", F.lit(rf"(?is)({anchor}.*?)(?={anchor}|\z)"), F.lit(1))
    indexed = dates.to_iso(dates.parse_date(F.regexp_extract(
        H.visible_text(F.col("html")), r"First indexed by TinEye on\s+([A-Za-z]+ \d{1,2}, \d{4})", 1), as_of))

    def one(b):
        link = H.attribute(F.regexp_extract(b, r"(?is)^(<a\b[^<>]*)", 1), "href")
        hrefs = F.transform(F.regexp_extract_all(b, F.lit(r'(?is)<a\b[^<>]*href="(http[^"]*)"'), F.lit(1)), lambda h: H.unescape(h))
        picture = F.get(F.filter(hrefs, lambda h: (h != link) & h.rlike(TINEYE_IMAGE)), F.lit(0))
        crawl = F.regexp_extract(b, r'(?is)data-test="crawl-date"[^>]*>\s*([^<]*?)\s*<', 1)
        text = H.visible_text(b)
        size = F.regexp_extract(text, r"(\d{2,5})\s*x\s*(\d{2,5})", 1)
        return F.struct(
            F.when(link.startswith("http"), link).alias("link"), F.lit("").alias("title"), picture.alias("thumbnail"),
            picture.alias("image_url"), F.lit("exact").alias("match_type"),
            dates.to_iso(dates.parse_date(crawl, as_of)).alias("crawl_date"), F.col("first_indexed"),
            F.when(size != "", F.array(
                size.cast("int"), F.regexp_extract(text, r"(\d{2,5})\s*x\s*(\d{2,5})", 2).cast("int")
            )).alias("image_size"),
        )

    return _explode(pages.withColumn("first_indexed", indexed), F.transform(blocks, one))


def unwrap_redirect(href: Column) -> Column:
    """The target behind a result-page redirect (``u=a1<base64url>``); other links stay, broken ones go."""
    token = F.regexp_replace(F.regexp_extract(href, r"[?&]u=([^&#]*)", 1), "^a1", "")
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    target = F.when(token.rlike("^[A-Za-z0-9_-]+$"), F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(~F.contains(href, F.lit("bing.com/ck/a")), href).otherwise(F.when(target.startswith("http"), target))


def rendered_bing(pages: DataFrame) -> DataFrame:
    """Leads of a rendered text page (``inv_id, engine, copy_id, html, final_url``) with its caption."""
    asked = urls.unquote_plus(F.regexp_extract("final_url", r"[?&]q=([^&#]*)", 1))
    caption = F.when((asked != "") & ~asked.startswith("imgurl:"), asked)
    items = F.regexp_extract_all("html", F.lit(r'(?is)<li\b[^>]*class="[^"]*\bb_algo\b[^"]*"[^>]*>(.*?)</li>'), F.lit(1))

    def one(b):
        anchor = r'(?is)<a\b[^>]*href="(http[^"]*)"[^>]*>(.*?)</a>'
        head = F.regexp_extract(b, r"(?is)<h2\b[^>]*>(.*?)</h2>", 1)
        scope = F.when(head.rlike(anchor), head).otherwise(b)
        return F.struct(
            let(unwrap_redirect(H.unescape(F.regexp_extract(scope, anchor, 1))), lambda u: F.when(
                ~u.rlike(r"bing\.com|microsoft\.com"), u)).alias("link"),
            H.visible_text(F.regexp_extract(scope, anchor, 2)).alias("title"),
            F.lit("organic").alias("match_type"),
            H.visible_text(F.regexp_extract(b, r"(?is)<p\b[^>]*>(.*?)</p>", 1)).alias("snippet"),
            F.col("caption"),
        )

    return _explode(pages.withColumn("caption", caption), F.transform(items, one))


# -------------------------------------------------------------------------------------- answer texts

def harvest_links(responses: DataFrame) -> DataFrame:
    """Text and links of an answer: cited ones, those carried by tool results, those written in the text;
    first-seen order, own host dropped."""
    items = _list(F.col("v"), "$.output")
    is_message = lambda i: F.coalesce(_text(i, "$.type") == "message", F.lit(False))
    parts = F.flatten(F.transform(F.filter(items, is_message), lambda i: _list(i, "$.content")))
    texts = F.filter(F.transform(
        F.filter(parts, lambda c: _text(c, "$.type").isin("output_text", "text")), lambda c: _text(c, "$.text")
    ), lambda t: F.coalesce(t, F.lit("")) != "")
    text = F.array_join(texts, "\n")
    listed = F.flatten(F.transform(items, lambda i: F.when(is_message(i), F.flatten(F.transform(
        _list(i, "$.content"), lambda c: F.transform(_list(c, "$.annotations"), lambda a: _text(a, "$.url"))
    ))).otherwise(F.regexp_extract_all(F.to_json(i), F.lit(r"(https?://[^\s\"'<>\\]+)"), F.lit(1)))))
    written = F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>)\]]+)"), F.lit(1))
    bare = F.transform(F.array_compact(F.concat(listed, written)), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
    links = F.array_distinct(F.filter(bare, lambda u: (u != "") & ~F.contains(u, F.lit(OWN_ANSWER_HOST))))
    return _parsed(responses).select("inv_id", text.alias("text"), links.alias("links"))


def answer_text(body: Column) -> Column:
    """The assistant's text in any of three shapes; the raw body when there is none."""
    def read(v):
        said = F.filter(_list(v, "$.output"), lambda i: F.coalesce(
            (_text(i, "$.role") == "assistant") & (_text(i, "$.type") == "message"), F.lit(False)))
        plain = F.transform(said, lambda i: F.coalesce(
            F.array_join(F.transform(F.filter(
                F.try_variant_get(i, "$.content", _ITEMS), lambda c: F.coalesce(_text(c, "$.type") == "output_text", F.lit(False))
            ), lambda c: F.coalesce(_text(c, "$.text"), F.lit(""))), "\n"),
            _text(i, "$.content"),
        ))
        found = F.coalesce(
            _text(v, "$.message.content"), _text(v, "$.choices[0].message.content"), F.array_join(plain, "\n"))
        return F.when(F.coalesce(strip(found), F.lit("")) != "", found).otherwise(body)

    return let(F.try_parse_json(body), read)


def lenient_json(text: Column) -> Column:
    """The text as JSON, else the span from its first ``{`` to its last ``}``, else null."""
    return F.coalesce(
        F.try_parse_json(text), F.try_parse_json(blank_to_null(F.regexp_extract(text, r"(?s)(\{.*\})", 1))))


# ------------------------------------------------------------------------------------ post metadata

def post_info(posts: DataFrame) -> DataFrame:
    """X post metadata from the first shape that answered. ``posts``: ``url, embed_body, mirror_body``."""
    e, m = F.try_parse_json("embed_body"), F.try_parse_json("mirror_body")
    p = posts.withColumns({"e": e, "m": F.try_variant_get(m, "$.tweet", "variant"), "post": urls.x_post(F.col("url"))})
    photos = F.concat(
        F.transform(_list(F.col("e"), "$.photos"), lambda x: _text(x, "$.url")),
        F.transform(_list(F.col("e"), "$.mediaDetails"), lambda x: _text(x, "$.media_url_https")),
        F.array(_text(F.col("e"), "$.video.poster")),
    )
    mirrored = F.concat(
        F.transform(_list(F.col("m"), "$.media.photos"), lambda x: _text(x, "$.url")),
        F.transform(_list(F.col("m"), "$.media.videos"), lambda x: _text(x, "$.thumbnail_url")),
    )

    def full(a):
        return F.transform(F.filter(F.array_compact(a), lambda u: u != ""), urls.original_size_url)

    usable = (F.size(_list(F.col("e"), "$.photos")) > 0) | (F.size(_list(F.col("e"), "$.mediaDetails")) > 0) | (
        F.coalesce(_text(F.col("e"), "$.text"), F.lit("")) != "")
    p = p.withColumn("info", F.when(usable, F.struct(
        first_nonblank(_text(F.col("e"), "$.user.screen_name"), F.col("post.user")).alias("user"),
        F.coalesce(_text(F.col("e"), "$.text"), F.lit("")).alias("text"), _text(F.col("e"), "$.created_at").alias("created_at"),
        F.array_distinct(full(photos)).alias("photos"),
    )).when(F.col("m").isNotNull(), F.struct(
        first_nonblank(_text(F.col("m"), "$.author.screen_name"), F.col("post.user")).alias("user"),
        F.coalesce(_text(F.col("m"), "$.text"), F.lit("")).alias("text"), _text(F.col("m"), "$.created_at").alias("created_at"),
        full(mirrored).alias("photos"),
    )))
    return p.filter(F.col("post").isNotNull() & F.col("info").isNotNull()).select("url", F.col("post.id").alias("id"), "info.*")


def cover_info(posts: DataFrame) -> DataFrame:
    """Cover, title and author of a video post. ``posts``: ``url, body``."""
    v = F.try_parse_json("body")
    fields = ("thumbnail_url", "title", "author_name", "author_url")
    rows = posts.withColumn("v", v).filter(F.contains(F.col("url"), F.lit("tiktok.com"))).select(
        "url", *[_text(F.col("v"), f"$.{f}").alias(f) for f in fields])
    return rows.filter(first_nonblank(F.col("thumbnail_url"), F.col("title")).isNotNull())
