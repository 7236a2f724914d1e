"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by where it stands (navigation,
headers, footers, asides, forms, adverts, notices, comments are out), its link density, its length and its density of
stop words; what it leaves open, short blocks above all, takes the label of the nearest decided neighbours in the second
pass. Blocks within an article or main element are in unless something rules them out. White space within a block
becomes one space, character references are decoded, blocks that are in are joined by a line end.

Defined results: a null or empty page has an empty text; a tag that never ends is text; markup that is not closed or not balanced ends where its
parent ends; rows that repeat are extracted one by one; only page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
#: An attribute, or what else stands before the end of a tag. A quote opens a value only behind an equals sign.
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|=)")
_SPACE = re.compile(r"[\s/]*")
RAW = {"script", "style", "textarea", "template", "svg", "iframe", "object", "title", "canvas", "audio", "video", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUT = {"nav", "footer", "aside", "form", "head", "menu", "button", "dialog", "fieldset"}
#: Elements that are out unless they stand in an article.
OUT_BEFORE = {"header", "noscript"}
#: Words of class and id that mark what is not the main text.
OUT_WORD = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "aside", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent",
    "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "masthead", "widget", "toolbar", "hidden", "copyright", "disclaimer", "paywall",
}
#: Words that may stand beside one of OUT_WORD in a compound name, as in site-footer or related-posts.
BESIDE = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "box", "list", "block", "container", "wrapper", "wrap", "inner", "outer", "section", "area", "bar", "panel", "links", "link", "buttons", "button", "icons", "posts", "post", "articles", "item", "items", "form",
    "header", "content", "message", "text", "slot", "unit", "google", "fixed", "sticky", "mobile", "desktop", "small", "large", "thread", "policy", "js", "module", "region", "row", "col",
}
#: Class words about layout, which don't rule an article out that stands within.
LAYOUT = {"social", "share", "sharing", "banner", "notice", "alert", "login", "subscribe", "signup", "paywall", "overlay", "modal"}
OUT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
STOP = frozenset(
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or she that the their them they this to was we were which with you"
    " au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour que qui sa se ses son sont sur un une"
    " als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht oder sich sie sind und von war wie zu zum zur"
    " al como con de del el ella en es esta la las lo los más me no o para pero por que se su sus un una y".split()
)
HEADINGS = {f"h{k}" for k in range(1, 7)}
_LETTERS = re.compile(r"[^\W\d_]+")
MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.15, 0.25


class Block:
    __slots__ = ("parts", "links", "out", "inside", "heading")

    def __init__(self, out: bool, inside: bool, heading: bool):
        self.parts, self.links, self.out, self.inside, self.heading = [], 0, out, inside, heading


def _marked(value: str) -> set[str]:
    """The words of OUT_WORD for which a class or id stands: whole names, or compounds with nothing in them but such words, numbers and words of BESIDE."""
    found: set[str] = set()
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = [x for x in re.split(r"[-_:.]+", name) if x and not x.isdigit()]
        own = {x for x in parts if x in OUT_WORD}
        if own and all(x in OUT_WORD or x in BESIDE for x in parts):
            found |= own
    return found


def _excludes(name: str, attributes: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether what an element holds is not main text, by its name and attributes; and whether only by a class word about layout."""
    if name in OUT or (name in OUT_BEFORE and not inside):
        return True, False
    if not attributes:
        return False, False
    if attributes.get("role", "").lower() in OUT_ROLE or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True, False
    if name in ("html", "body", "article", "main"):
        return False, False
    words = _marked(attributes.get("class", "") + " " + attributes.get("id", ""))
    return bool(words - LAYOUT), bool(words)


def _tags(page: str):
    """(text, None, None, 0) and (None, name, attributes, closing as -1, opening as 1, closed at once as 0) in order, without comments and raw elements."""
    at, start, end = 0, 0, len(page)
    last = page.rfind(">")
    while True:
        at = page.find("<", at)
        if at < 0 or at >= last:
            break
        head = page[at + 1 : at + 2]
        if head == "!" or head == "?":
            stop = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            z = page.find(stop, at + (4 if stop == "-->" else 1))
            yield page[start:at], None, None, 0
            at = start = end if z < 0 else z + len(stop)
            continue
        named = _NAME.match(page, at + 1)
        if not named:
            at += 1
            continue
        z, attributes = _SPACE.match(page, named.end()).end(), {}
        while z < end and page[z] != ">":
            m = _ATTRIBUTE.match(page, z)
            if m[1]:
                attributes.setdefault(m[1].lower(), references.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
            z = _SPACE.match(page, m.end()).end()
        if z >= end:  # the tag never ends: it and all behind it is text
            break
        name, closing = named[1].lower(), head == "/"
        yield page[start:at], None, None, 0
        yield None, name, attributes, -1 if closing else 0 if page[z - 1] == "/" else 1
        if name in RAW and not closing and page[z - 1] != "/":
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, z)
            z = close.end() - 1 if close else end
        at = start = z + 1
    yield page[start:], None, None, 0


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """The page's blocks in order: text, link density, out, inside an article, heading."""
    found: list[Block] = []
    # open elements that matter: blocks, and others that are out. name, out, out but for an article within, inside an article, heading
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    of_block: list[int] = []  # places of blocks in the stack
    open_: Counter = Counter()
    links, fresh = 0, True
    for text, name, attributes, kind in _tags(page):
        if name is None:
            if not text:
                continue
            if fresh:
                _, hard, soft, inside, heading = stack[-1] if stack else ("", False, False, False, False)
                found.append(Block(hard or soft, inside, heading))
                fresh = False
            text = references.unescape(text)
            found[-1].parts.append(text)
            if links:
                found[-1].links += len("".join(text.split()))
            continue
        if name == "br":
            if not fresh:
                found[-1].parts.append(" ")
            continue
        if name in VOID or name in RAW:
            fresh = fresh or name in ("hr", "title")
            continue
        if name == "a":
            links = 1 if kind > 0 else 0
            continue
        if name in BLOCK:
            fresh, links = True, 0
        if kind < 0:
            if open_[name]:  # ends it and all that is open within
                while True:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
                    if of_block and of_block[-1] == len(stack):
                        of_block.pop()
                    if gone == name:
                        break
        elif kind > 0:
            if name in BLOCK and of_block:  # a block ends an open paragraph, an item an open item
                top = stack[of_block[-1]][0]
                if top == "p" or (top == name and name in ("li", "td", "th", "tr", "dt", "dd", "option")):
                    for x in stack[of_block[-1] :]:
                        open_[x[0]] -= 1
                    del stack[of_block.pop() :]
            _, hard, soft, inside, heading = stack[-1] if stack else ("", False, False, False, False)
            out, layout = _excludes(name, attributes, inside)
            article = name in ("article", "main")
            if name in BLOCK or out or layout:
                if name in BLOCK:
                    of_block.append(len(stack))
                open_[name] += 1
                stack.append((name, hard or out, layout or soft and not article, inside or article, heading or name in HEADINGS))
    rows = []
    for b in found:
        text = " ".join("".join(b.parts).split())
        if text:
            rows.append((text, b.links / max(1, len(text.replace(" ", ""))), b.out, b.inside, b.heading))
    return rows


def first_pass(text: str, density: float, out: bool, inside: bool, heading: bool) -> str:
    """good or bad where decided; near (leaning to good) or short where neighbours decide."""
    if out or (density > MAX_LINKS and not (inside and len(text) > LONG)):
        return "bad"
    if inside:
        return "near" if density > 0 and len(text) < SHORT else "good"
    if len(text) < SHORT or heading:
        return "bad" if density > 0 and not heading else "short"
    words = _LETTERS.findall(text.lower())
    share = sum(w in STOP for w in words) / max(1, len(words))
    if share >= STOP_HIGH and (len(text) > LONG or not density):
        return "good"
    return "near" if share >= STOP_LOW else "bad"


def second_pass(labels: list[str], sizes: list[int] | None = None) -> list[bool]:
    """Open blocks take the label of the nearest decided ones before and behind: near ones are in if either is good, short ones if both are, or if the nearer is. Where nothing is good, near ones are; where nothing is decided, nothing speaks against a block."""
    n = len(labels)
    if "good" not in labels:
        labels = ["good" if x == "near" else x for x in labels]
    before, behind = [None] * n, [None] * n
    for seen, order in ((before, range(n)), (behind, range(n - 1, -1, -1))):
        last = None
        for i in order:
            seen[i] = last
            if labels[i] in ("good", "bad"):
                last = i
    kept = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            kept.append(label == "good")
            continue
        around = [j for j in (before[i], behind[i]) if j is not None]
        good = [j for j in around if labels[j] == "good"]
        if label == "near":
            kept.append(bool(good) or not around)
        else:
            nearest = min((abs(i - j) for j in around), default=0)
            kept.append(not around or bool(good) and (len(good) == len(around) == 2 or min(abs(i - j) for j in good) <= nearest))
    return kept


def extract(page: str | None) -> str:
    found = blocks(page or "")
    keep = second_pass([first_pass(*b) for b in found])
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
