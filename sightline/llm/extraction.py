"""Main text of landed pages by two passes of block rules."""

from __future__ import annotations

import html as markup
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import on_bytes

# ---------------------------------------------------------------------------------------- Fixed values
STOP_WORDS = frozenset("""
the of and to in a is that for it on with as was be by this are at from or an have not which you but they his he had
her all there been one so will would can if their more has when who we were out up what about them than its
le la les de des du un une et en que qui dans pour par sur au aux avec est pas ne ce se il elle nous vous je plus son sa
ses ou mais comme cette leur sont été
der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
wird bei einer um am sind noch wie einem über
el los las y del se por con una su para al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre
también me hasta hay donde
""".split())
HIGH_STOPS, LOW_STOPS = 0.30, 0.15     # shares of a block's words
SHORT, LONG = 70, 200                  # characters
LINKED = 0.5                           # share of a block's characters inside links
#: What an article or main around a block adds to its stop words' share, what a mark takes off, and how many of these
#: the share of links is relieved of: the same rules with other thresholds.
LIFT, FALL, LINK_LIFT = 0.30, 2.0, 4.0
#: Elements whose content is no markup, and elements that hold no text of the page.
RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes"
UNREAD = frozenset("svg object canvas select button audio video map".split())
BOILERPLATE_TAGS = frozenset("head nav footer aside form dialog menu fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("body div section article main nav header footer aside form dialog menu fieldset head ul ol dl table details figure blockquote".split())
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption pre hr address summary legend thead tbody tfoot html center".split())
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset("""
ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr
notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navbar
navigation breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended widget comment
comments commentlist reply replies respond disqus complementary contentinfo search pagination pager
""".split())
#: Of these, words (and tags) of what is beside the article even if it holds articles of its own.
APART = frozenset("""
comment comments commentlist reply replies respond disqus aside sidebar complementary related recommended nav navbar
navigation menu
""".split())
#: Words for a box, which may stand beside a mark within one class: comment-list, cookie-bar.
BOXES = frozenset("""
area bar block body box container group inner item items list outer section wrap wrapper unit slot zone module panel holder thread link links icon icons
button buttons v user users reader readers site page post article entry story main primary secondary top bottom left right
""".split())
# ---------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attributes>(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^<>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[^a-zA-Z0-9]+")
_WORDS = re.compile(r"\w+")


class Block:
    """A run of text between block tags, with what the rules look at. ``edges``: of the article that it lies in."""
    __slots__ = ("edges", "heading", "label", "linked", "lift", "marked", "stops", "text")

    def __init__(self, text: str, heading: bool, linked: int, article: int, marked: bool):
        self.text, self.linked = text, linked / max(1, len(text))
        self.marked, self.edges, self.heading = marked, article, heading
        words = _WORDS.findall(text.lower())
        self.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        self.lift = -FALL if marked else LIFT if article else 0.0
        self.label = ""

    def first(self, told: bool) -> str:
        """First pass: good, bad, near (probably good) or short (not to be told alone). ``told``: whether the page has a
        stop word at all; a page in a language without any is judged by length and links."""
        stops, linked = (self.stops if told else HIGH_STOPS) + self.lift, self.linked - LINK_LIFT * self.lift
        if linked > LINKED or stops < 0:
            return "bad"
        if "\xa9" in self.text and len(self.text) < LONG and not self.lift:
            return "bad"
        if len(self.text) < SHORT:
            return "bad" if linked > 0 else "short"
        if stops >= HIGH_STOPS:
            return "good" if len(self.text) > LONG else "near"
        if stops >= LOW_STOPS:
            # A long block stands on its own; where links take some of it, its neighbours must speak for it.
            return "good" if len(self.text) > LONG and not self.linked else "near"
        return "bad" if self.linked else "near"


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether class, id, role or style mark a holder, and whether what they name is apart from the article or unseen.
    A class counts as a whole: ``cookie-notice`` and ``ad-300x250`` are marks, ``has-sidebar`` is not."""
    if not attributes:
        return False, False
    if _HIDDEN.search(attributes) is not None:
        return True, True
    marked = apart = False
    for token in " ".join("".join(m) for m in _NAMES.findall(attributes)).lower().split():
        words = {p.rstrip("0123456789") for p in _PARTS.split(token) if p and not p[0].isdigit()}
        if words & MARKS and words <= MARKS | BOXES:
            marked, apart = True, apart or not words.isdisjoint(APART)
    return marked, apart


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with their first labels. Holders that are never closed end with the holder
    around them, elements without text of the page at the latest where what holds them ends; without an end tag at all
    they hold nothing."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # holder, number of the article, what is marked, what is apart
    text: list[str] = []
    linked, lines, articles, heading = 0, 0, 0, False
    link = None                       # holders around the link that is open
    unread: list[str] = []            # an element that is passed over, and block tags opened in it
    ends: dict[str, int] = {}         # where the last end tag of an element is

    def end() -> None:
        nonlocal linked, lines
        joined = " ".join("".join(text).split())
        if joined:
            found.append(Block(joined, heading, linked, *(stack[-1][1:3] if stack else (0, False))))
        text.clear()
        linked = lines = 0

    for m in _TOKEN.finditer(page):
        if (piece := m["text"]) is not None:
            if unread:
                continue
            piece = markup.unescape(piece)
            text.append(piece)
            if not piece.isspace():
                lines = 0
            if link is not None:
                linked += len("".join(piece.split()))
            continue
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if unread:
            if tag == unread[0] or tag in BLOCKS:
                if not m["close"]:
                    if not m["attributes"].endswith("/"):
                        unread.append(tag)
                    continue
                if tag in unread:
                    while unread.pop() != tag:
                        pass
                    continue
                unread.clear()        # the end of what is around it
            else:
                continue
        if tag == "a":
            link = None if m["close"] else len(stack)
        elif tag == "br":
            text.append(" ")
            lines += 1
            if lines > 1:
                end()
        elif tag in UNREAD:
            if tag not in ends:
                ends[tag] = max((e.start() for e in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1)
            if not m["close"] and not m["attributes"].endswith("/") and ends[tag] > m.start():
                unread = [tag]
        elif tag in BLOCKS:
            end()
            while stack and (not stack[-1][0] or (stack[-1][0] == "head" and not m["close"])):
                stack.pop()           # a marked paragraph ends with the next block tag, a head with the first
            heading = tag in HEADINGS and not m["close"]
            _, article, marked, apart = stack[-1] if stack else ("", 0, False, False)
            if m["close"]:
                if any(s[0] == tag for s in stack):
                    while stack.pop()[0] != tag:
                        pass
                if link is not None and len(stack) < link:
                    link = None       # never closed
            elif tag == "body":
                stack[:] = [("body", 0, False, False)]
            elif tag in MAIN_TAGS:
                # Whatever the holders around it are called, unless it is a comment or stands beside the article.
                own = apart or _marked(m["attributes"])[1]
                articles += not article
                stack.append((tag, article or articles, own, own))
            else:
                named, beside = _marked(m["attributes"])
                if tag in HOLDERS:
                    # A page's own header is not its article; a header inside the article holds its title.
                    bad = tag in BOILERPLATE_TAGS or (tag == "header" and not article) or named
                    stack.append((tag, article, marked or bad, apart or beside or tag in APART))
                elif named:
                    stack.append(("", article, True, apart or beside))
    end()
    told = any(b.stops and not b.marked for b in found)
    for b in found:
        b.label = b.first(told)
    # Where nothing is good and no article speaks for itself, the best there is has to do.
    labels = {"good" if b.edges and not b.marked else b.label for b in found}
    best = next((x for x in ("good", "near", "short") if x in labels), None)
    for b in found if best != "good" else []:
        b.label = "good" if b.label == best else b.label
    return found


def settle_labels(found: list[Block]) -> list[Block]:
    """Second pass: the good blocks. A short or near block inherits from its nearest decided neighbours: good beside
    good, bad between bad; between the two, near is good and short follows the nearer one; where both are as near, a heading the one after it. The edges of an article count
    as good, those of the page as bad; inside an article, what is marked tells nothing about the blocks beside it."""
    def nearest(order, edge: int) -> dict[int, tuple[str, int]]:
        sides, last, article = {}, ("bad", edge), 0
        for i in order:
            b = found[i]
            if b.edges != article:
                # In: the article's edge. Out again: its text tells nothing about what stands beside it.
                last, article = ("good" if b.edges else "bad", i), b.edges
            sides[i] = (last[0], abs(i - last[1]))
            if b.label in ("good", "bad") and not (b.edges and b.marked):
                last = (b.label, i)
        return sides

    before, after = nearest(range(len(found)), -1), nearest(range(len(found) - 1, -1, -1), len(found))
    kept = []
    for i, b in enumerate(found):
        left, right = before[i], after[i]
        sides = {left[0], right[0]}
        if b.label == "good" or (b.label == "near" and ("good" in sides or b.stops >= HIGH_STOPS)):
            kept.append(b)
        elif b.label == "short" and "good" in sides and (sides == {"good"} or (left if left[1] < right[1] + (not b.heading) else right)[0] == "good"):
            kept.append(b)
    return kept


def main_text(page: str) -> str:
    return "\n".join(b.text for b in settle_labels(blocks_of(page)))


def extract_pages(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """The article of each landed page, without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments.

    ``pages``: ``page_id`` (or another column named as ``id``, such as ``url``) and ``html``; others are not read. Returns one row per row:
    the id, ``text, n_blocks``. Blocks are joined in page order by a line end; white space within a block is one space; character
    references are decoded.

    Every block goes through the two passes. An ``article`` or ``main`` around it lowers what is asked of its stop words
    and links, a holder marked as boilerplate raises it beyond reach; the edges of an article count as good neighbours,
    those of the page as bad ones. An article in a marked holder is still the article, unless that holder is hidden, a
    comment, an aside or a menu. A class marks its holder only as a whole, not by a part of its name (``has-sidebar``).
    A page without a stop word of any list is told by length and links alone, and where no block is good or in an article,
    near ones are good, or else short ones. A null or empty page, or one without a
    good block, has an empty text. Unclosed and cut-off markup ends with what holds it, or with the page. Pages are read
    whole; rows that repeat are read each. No shuffle."""
    def step(batch):
        texts, n = [], []
        for page in map(pa.StringScalar.as_py, batch.column(1)):
            kept = settle_labels(blocks_of(page)) if page else []
            texts.append("\n".join(b.text for b in kept))
            n.append(len(kept))
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32())], [id, "text", "n_blocks"])

    rows = pages.select(F.col(id), F.col(html).alias("_html"))
    return on_bytes(rows, step, f"{id} {rows.schema[id].dataType.simpleString()}, text string, n_blocks int")
