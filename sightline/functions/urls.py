"""URL identity and classification as native Column expressions.

URLs are split with our own patterns because ``parse_url`` refuses inputs a lenient splitter accepts
(spaces, non-ASCII hosts). Every function takes a string Column and returns a Column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import let

# --- Fixed values (results depend on them) ---------------------------------------------------------
DROPPED_QUERY_PREFIXES = (
    "utm_", "fbclid", "gclid", "igsh", "igshid", "ref", "ref_src", "refsrc", "lang", "hl", "locale",
    "src", "s", "t", "feature", "mibextid", "__cft__", "__tn__", "rdid", "share_url", "sfnsn",
    "is_from_webapp", "sender_device", "web_id", "q", "srcom",
)
HOST_FOLDS = {
    "twitter.com": "x.com", "mobile.twitter.com": "x.com", "www.twitter.com": "x.com",
    "www.x.com": "x.com", "m.facebook.com": "www.facebook.com",
    "mbasic.facebook.com": "www.facebook.com", "web.facebook.com": "www.facebook.com",
    "m.youtube.com": "www.youtube.com", "youtu.be": "www.youtube.com",
}
JUNK_HOST_TOKENS = (
    "google.", "lens.google", "bing.com", "yandex.", "tineye.com", "duckduckgo.com",
    "webcache.googleusercontent.com", "translate.goog", "archive.org", "archive.ph", "serpapi.com",
)
SOCIAL_HOSTS = (
    "twitter.com", "x.com", "facebook.com", "instagram.com", "t.me", "telegram.me", "reddit.com",
    "tiktok.com", "youtube.com", "youtu.be", "threads.net", "threads.com", "vk.com",
)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif", ".bmp")
PLATFORM_HOSTS = (
    ("x", ("x.com", "twitter.com")), ("instagram", ("instagram.com",)), ("facebook", ("facebook.com",)),
    ("tiktok", ("tiktok.com",)), ("telegram", ("t.me", "telegram.me")),
    ("youtube", ("youtube.com", "youtu.be")), ("reddit", ("reddit.com",)),
    ("pinterest", ("pinterest.",)), ("threads", ("threads.net", "threads.com")),
)
FACET_HOSTS = (
    ("x.com", "X"), ("twitter.com", "X"), ("facebook.com", "Facebook"), ("instagram.com", "Instagram"),
    ("youtube.com", "YouTube"), ("youtu.be", "YouTube"), ("tiktok.com", "TikTok"), ("t.me", "Telegram"),
    ("telegram.me", "Telegram"), ("reddit.com", "Reddit"), ("threads.net", "Threads"),
    ("threads.com", "Threads"), ("vk.com", "VK"), ("linkedin.com", "LinkedIn"),
    ("pinterest.", "Pinterest"), ("snapchat.com", "Snapchat"),
)
FACETS = ("X", "TikTok", "Instagram", "Facebook", "Telegram", "Reddit", "YouTube")
FACET_OTHER = "ويب"
X_STATUS_PATH = r"^/(?:[A-Za-z0-9_]{1,15}|i/web|i)/status(?:es)?/(\d{15,20})(?:/.*)?$"
LISTING_PATTERN = (
    r"(?i)(^/$)|/(topic|topics|tag|tags|category|categories|author|authors|search|archive|archives|latest|"
    r"photos|gallery|galleries|videos|discover|explore|hashtag)(/|$)|/page/\d+(/|$)|[?&](page|p)=\d+"
)
PROFILE_PATTERN = (
    r"^https://(x\.com|www\.instagram\.com|www\.tiktok\.com|www\.facebook\.com|www\.pinterest\.[a-z.]+|"
    r"[a-z]{2}\.pinterest\.com|www\.threads\.(net|com))/@?[A-Za-z0-9_.-]+/?$"
)
MARKED_PROFILE_PATTERN = (
    r"(?i)^https://(?:(?:www\.)?snapchat\.com/(?:@|add/)[^/?]+"
    r"|(?:[a-z]{2,3}\.)?linkedin\.com/(?:in|company|school|pub)/[^/?]+"
    r"|www\.youtube\.com/(?:@[^/?]+|(?:channel|c|user)/[^/?]+)(?:/(?:videos|featured|shorts|streams|community))?"
    r"|(?:t\.me|telegram\.me)/(?:s/)?[A-Za-z0-9_]+"
    r"|(?:www\.|old\.)?reddit\.com/(?:r|u|user)/[^/?]+)/?$"
)
X_POST_PATTERN = r"(?:twitter\.com|x\.com)/([A-Za-z0-9_]{1,15})/status(?:es)?/(\d{15,20})"
INSTAGRAM_POST_PATTERN = r"instagram\.com/(?:[A-Za-z0-9_.]+/)?(?:p|reel|reels|tv)/([A-Za-z0-9_-]{9,12})"
YOUTUBE_VIDEO_PATTERN = (
    r"(?:youtube\.com/(?:watch\?(?:.*&)?v=|shorts/|embed/)|youtu\.be/)([A-Za-z0-9_-]{11})"
)
YOUTUBE_FRAMES = ("maxresdefault", "hq1", "hq2", "hq3")
MANUAL_ENGINE_LINKS = {
    "google": ("https://lens.google.com/uploadbyurl?url=", ""),
    "bing": ("https://www.bing.com/images/search?q=imgurl:", "&view=detailv2&iss=sbi"),
    "yandex": ("https://yandex.com/images/search?rpt=imageview&url=", ""),
    "tineye": ("https://tineye.com/search?url=", ""),
}
STORAGE_HOST = "r2.cloudflarestorage.com"
# ---------------------------------------------------------------------------------------------------

_SPLIT = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_ANY_PATH = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_WHITESPACE = " \t\n\r\f\u000b"


def _alternatives(tokens) -> str:
    return "|".join(re.escape(t) for t in tokens)


def _on_label(hosts) -> str:
    """Pattern for a host equal to, or a subdomain of, one of ``hosts``."""
    return rf"(^|\.)({_alternatives(hosts)})$"


def clean(url: Column) -> Column:
    return F.translate(F.trim(url, F.lit(_WHITESPACE)), "\t\r\n", "")


def netloc_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean(url), _SPLIT, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(clean(url), _ANY_PATH, 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(clean(url), _SPLIT, 3)


def host_of(url: Column) -> Column:
    """Lower-case host without user-info and port; '' when there is none."""
    host = F.regexp_extract(clean(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)", 1)
    bracketed = F.regexp_extract(clean(url), r"^[^/]*//(?:[^/?#]*@)?\[([^\]/?#]*)\]", 1)
    return F.coalesce(F.lower(F.when(url.contains("["), bracketed).otherwise(host)), F.lit(""))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def quote_plus(text: Column) -> Column:
    """Form encoding with the unreserved set ``_ . - ~``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def quote(text: Column) -> Column:
    return F.replace(quote_plus(text), F.lit("+"), F.lit("%20"))


def unquote_plus(text: Column) -> Column:
    """Lenient decoding: a stray percent sign stays as it is."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_pairs(query: Column) -> Column:
    """``array<struct<k,v>>`` of the pairs that have a non-empty value, in order."""
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    return F.transform(
        parts,
        lambda p: F.struct(
            unquote_plus(F.substring_index(p, "=", 1)).alias("k"),
            unquote_plus(F.regexp_replace(p, "^[^=]*=", "")).alias("v"),
        ),
    )


def _encode_pairs(pairs: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(pairs), lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))),
        "&",
    )


def _fold_host(host: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in HOST_FOLDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, host), host)


def _canonical_from_parts(raw_host: Column, raw_path: Column, raw_query: Column) -> Column:
    host = _fold_host(raw_host)
    dropped = "^(" + _alternatives(DROPPED_QUERY_PREFIXES) + ")"
    youtube = host == "www.youtube.com"
    short_link = raw_host == "youtu.be"
    video = F.trim(raw_path, F.lit("/"))
    kept = F.filter(
        query_pairs(raw_query),
        lambda p: ~F.lower(p["k"]).rlike(dropped) & (~youtube | (p["k"] == "v")),
    )
    query = (
        F.when(short_link, F.concat(F.lit("v="), quote_plus(video)))
        .when(raw_query.contains("="), _encode_pairs(kept))
        .otherwise("")
    )
    path = (
        F.when(short_link, F.lit("/watch"))
        .when(F.length(raw_path) > 1, F.rtrim(raw_path, F.lit("/")))
        .when(raw_path == "", F.lit("/"))
        .otherwise(raw_path)
    )
    status = F.when(host == "x.com", F.regexp_extract(path, X_STATUS_PATH, 1)).otherwise("")
    tail = F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path)
    return F.concat(
        F.lit("https://"), host, F.when(status != "", F.concat(F.lit("/i/status/"), status)).otherwise(tail)
    )


def _is_http(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def canonical(url: Column) -> Column:
    """Identity of a link: two links to one post compare equal; null when not an http(s) URL."""
    parts = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"))
    return let(parts, lambda p: F.when(
        _is_http(url) & (p["host"] != ""), _canonical_from_parts(p["host"], p["path"], p["query"])
    ))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def is_junk_host(host: Column) -> Column:
    return (host == "") | host.rlike(_alternatives(JUNK_HOST_TOKENS))


def is_junk(url: Column) -> Column:
    return let(host_of(url), is_junk_host)


def is_social_host(host: Column) -> Column:
    return host.rlike(_on_label(SOCIAL_HOSTS))


def is_social(url: Column) -> Column:
    return is_social_host(host_of(url))


def is_image_url(url: Column) -> Column:
    return F.coalesce(
        path_of(url).rlike("(?i)(" + _alternatives(IMAGE_EXTENSIONS) + ")$"), F.lit(False)
    )


def is_listing_canonical(canon: Column) -> Column:
    tail = F.regexp_extract(canon, r"(?s)^https://[^/?]*(.*)$", 1)
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.coalesce(
        tail.rlike(LISTING_PATTERN) | canon.rlike(PROFILE_PATTERN) | canon.rlike(MARKED_PROFILE_PATTERN),
        F.lit(False),
    )


def is_listing(url: Column) -> Column:
    """Pages that show whatever is newest (topics, tags, profiles, page N): never an origin."""
    return let(canonical(url), is_listing_canonical)


def platform_of_host(host: Column) -> Column:
    out = None
    for name, hosts in PLATFORM_HOSTS:
        inside = [h for h in hosts if h.endswith(".")]
        whole = [h for h in hosts if not h.endswith(".")]
        test = host.rlike(_on_label(whole)) if whole else host.contains(inside[0])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("web")


def platform_of(url: Column) -> Column:
    return let(host_of(url), platform_of_host)


def platform_facet(url: Column) -> Column:
    """Reader-facing label: seven named platforms, everything else is "web"."""
    def label(host):
        out = None
        for token, name in FACET_HOSTS:
            test = host.rlike(rf"^{re.escape(token)}|\.{re.escape(token)}$")
            shown = name if name in FACETS else FACET_OTHER
            out = F.when(test, shown) if out is None else out.when(test, shown)
        return out.otherwise(FACET_OTHER)

    return let(F.regexp_replace(host_of(url), r"^(www|m|mobile)\.", ""), label)


IDENTITY_COLUMNS = ("host", "domain", "canonical", "is_junk", "is_social", "is_listing", "platform")


def with_url_identity(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, domain, canonical and the class flags in staged projections, so each part is
    computed once per row instead of once per use."""
    u = F.col(url)
    df = df.withColumn("host", host_of(u)).withColumns({"_path": path_of(u), "_query": query_of(u)})
    df = df.withColumns({
        "domain": F.regexp_replace("host", r"^www\.", ""),
        "canonical": F.when(
            _is_http(u) & (F.col("host") != ""),
            _canonical_from_parts(F.col("host"), F.col("_path"), F.col("_query")),
        ),
    }).drop("_path", "_query")
    return df.withColumns({
        "is_junk": is_junk_host(F.col("host")),
        "is_social": is_social_host(F.col("host")),
        "is_listing": is_listing_canonical(F.col("canonical")),
        "platform": platform_of_host(F.col("host")),
    })


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def x_post(url: Column) -> Column:
    """``struct<user,id>`` of an X post link, else null."""
    post = F.regexp_extract(url, X_POST_PATTERN, 2)
    return F.when(post != "", F.struct(F.regexp_extract(url, X_POST_PATTERN, 1).alias("user"), post.alias("id")))


def instagram_code(url: Column) -> Column:
    return _nonempty(F.regexp_extract(url, INSTAGRAM_POST_PATTERN, 1))


def youtube_id(url: Column) -> Column:
    return _nonempty(F.regexp_extract(url, YOUTUBE_VIDEO_PATTERN, 1))


def instagram_media_url(url: Column) -> Column:
    return F.concat(F.lit("https://www.instagram.com/p/"), instagram_code(url), F.lit("/media/?size=l"))


def youtube_frame_urls(url: Column) -> Column:
    """Poster and three storyboard frames; null when the link is not a video."""
    vid = youtube_id(url)
    frames = F.array(*[
        F.concat(F.lit("https://i.ytimg.com/vi/"), vid, F.lit(f"/{name}.jpg")) for name in YOUTUBE_FRAMES
    ])
    return F.when(vid.isNotNull(), frames)


def original_size_url(url: Column) -> Column:
    return F.concat(F.substring_index(_nonempty(url), "?", 1), F.lit("?name=orig"))


def storage_key(url: Column, storage_host: str = STORAGE_HOST) -> Column:
    """Object key of a signed own-bucket link, else null."""
    key = F.regexp_extract(path_of(url), r"(?s)^/*[^/]+/(.+)$", 1)
    return F.when(netloc_of(url).contains(storage_host), _nonempty(key))


def manual_engine_links(image_url: Column) -> Column:
    target = quote(image_url)
    return F.struct(*[
        F.concat(F.lit(head), target, F.lit(tail)).alias(name)
        for name, (head, tail) in MANUAL_ENGINE_LINKS.items()
    ])


def fold_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..`` segments; ``..`` at the root stays there."""
    none = F.array().cast("array<string>")
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    last = F.element_at(parts, -1)
    # A last segment that names a folder leaves its slash.
    whole = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)

    def step(kept, part):
        return F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(
            part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(whole, none, step), "/"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def resolve_link(link: Column, base: Column) -> Column:
    """Absolute form of ``link`` found on the page ``base``; dot segments of a relative link's path are folded."""
    link = F.trim(link, F.lit(_WHITESPACE))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*((?:/[^/?#]*)*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, fold_dots(path), rest))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#") | (link == ""), base)
        .otherwise(F.concat(origin, fold_dots(F.concat(folder, path)), rest))
    )
