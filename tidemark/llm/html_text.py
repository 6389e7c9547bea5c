"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: every block element and line break ends a line. A line weighs its text
length, and 0 inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments
(told by element, role, class or id) and where it is mostly links. Sums of weights over sliding windows
of LINES lines show where text surges up and where it dives to nothing; the lines between are the main
text. A stretch must reach LEAST_SURGE in some window and a fifth of the longest stretch.

An article or main element that holds most of the page's text is its zone. A line in it weighs as much
more as a stretch must reach, so that short paragraphs count, and the zone's edge is a dive, so that no
stretch goes on across it. An element that holds less, a teaser card say, changes no weight. Without a
zone, what lies between two kept stretches stays, and so do short lines after them that end a sentence;
a first heading that only links part from the text goes with it.

A class or id tells a menu, an advert and the like only as a whole: a known name, or a compound of
known names and words of layout. Ids of headings, and of sections in an article, tell nothing; of
paragraphs and headings in an article only names of adverts do.

Result: blocks in page order joined by a line feed, white space inside a block made one blank,
character references decoded. Nulls: a null or empty page has empty text; page_id and url may be
null. Tags cut short at the page's end, unclosed elements and stray end tags are taken as browsers
do roughly; an unwanted inline element ends with its own end tag or the block around it. Each page is
read once, in time linear in its length. Rows come out one for one; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import staging

LINES = 3
LEAST_SURGE = 80
MOST_LINKED = 0.5

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "object",
    "math", "mfrac", "mi", "mn", "mo", "mover", "mrow", "msqrt", "msub", "msubsup", "msup", "mtext", "munder", "semantics",
}
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_DROPPED = {
    "nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg",
    "canvas", "audio", "video", "datalist", "map",
}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu",
          "menubar", "toolbar", "form"}
_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
    "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side",
    "footer", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "newsletter", "subscribe",
    "signup", "login", "related", "recommended", "share", "sharing", "social", "widget", "widgets", "pagination",
    "pager", "toolbar", "masthead", "topbar", "copyright", "disclaimer", "skip",
}
_HEADERS = {"header", "masthead"}
#: Names that tell of a paragraph or heading in an article, too; others may be its subject.
_ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
            "promotion", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe"}
#: What may stand beside such a name in one class or id that still means the same ("ad-slot", "related-posts").
_BESIDE = {
    "slot", "box", "bar", "list", "item", "items", "area", "wrap", "wrapper", "container", "block", "unit", "panel",
    "link", "links", "button", "buttons", "icon", "icons", "inner", "outer", "top", "bottom", "left", "right", "main",
    "site", "page", "global", "primary", "secondary", "mobile", "desktop", "post", "posts", "article", "articles",
    "story", "stories", "news", "form", "row", "col", "column", "section", "header", "title", "text", "media", "user",
    "thread", "count", "to", "google", "leaderboard", "sticky", "fixed", "inline", "native", "unit", "label",
}

_TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ENDED = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>?)|[!?][^>]*>?)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    """Is what the element holds no part of the main text?"""
    if name in _DROPPED or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id"):
            if key == "id" and (name in _TITLES or (name == "section" and in_article)):
                continue  # made of the heading's words
            names = _ADVERTS if in_article and (name == "p" or name in _TITLES) else _NAMES
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token) if not w.isdigit()]
                told = [w in names or (w in _HEADERS and not in_article) for w in words]
                if "".join(words) in names or (any(told) and all(
                        t or w in _BESIDE for t, w in zip(told, words, strict=True))):
                    return True
    return False


def lines(page: str) -> Iterator[tuple[str, int, bool, int, bool]]:
    """(text, characters in links, unwanted, 2 in an article, 1 in main, else 0, heading h1) of each line."""
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    linked = links = 0
    at, n = 0, len(page)
    unwanted, place = False, 0
    # An unwanted inline element that is open: its name, open elements of that name, blocks around it.
    skipped, depth, around = "", 0, 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        found = (text, linked, unwanted, place, any(x[0] == "h1" for x in stack[-3:]))
        parts, linked = [], 0
        return found

    while at < n:
        tag = _TAG.search(page, at)
        end = tag.start() if tag else n
        if end > at and not skipped:
            text = html.unescape(page[at:end])
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not tag:
            break
        at = tag.end()
        if tag.group().startswith("<!--"):
            close = page.find("-->", at)
            at = n if close < 0 else close + 3
            continue
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag.group(1)), tag.group(3) or ""
        if name in _RAW and not closing:
            if not attributes.endswith("/") or name in ("script", "style"):
                close = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
                at = n if not close else close.end()
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in _INLINE:
            whole = attributes.endswith("/")
            if skipped:
                if name == skipped and not whole:
                    depth += -1 if closing else 1
                    skipped = skipped if depth else ""
            elif name in ("span", "label", "small", "strong", "em", "a") and attributes and not closing and not whole \
                    and _unwanted(name, attributes, place == 2):
                skipped, depth, around = name, 1, len(stack)
            continue
        yield flush()
        if name in _VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            links = 0
            if name == "body":
                stack = [s for s in stack if s[0] != "head"]
                unwanted, place = stack[-1][1:] if stack else (False, 0)
            if stack and stack[-1][0] == "p":
                stack.pop()
            unwanted, place = stack[-1][1:] if stack else (False, 0)
            stack.append((
                name, unwanted or _unwanted(name, attributes, place == 2),
                2 if name == "article" or re.search(r"\brole\s*=\s*[\"']?article\b", attributes, re.I) or place == 2
                else 1 if name == "main" or place == 1 else 0))
            if attributes.endswith("/"):
                stack.pop()
        if skipped and len(stack) < around:
            skipped = ""
        unwanted, place = stack[-1][1:] if stack else (False, 0)
    yield flush()


def between(weights: np.ndarray, least: int, total: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Stretches from surge to dive: where window sums rise from 0, and where they are 0 again.

    Those that reach `least` in a window and, of `total` (the weights if not given), a fifth of the most.
    """
    if not len(weights):
        return []
    total = weights if total is None else total
    sums = np.convolve(weights, np.ones(LINES, np.int64))[LINES - 1:]  # of LINES lines from each line on
    text = np.concatenate([[0], (sums > 0).astype(np.int8), [0]])
    surges, dives = np.flatnonzero(np.diff(text) > 0), np.flatnonzero(np.diff(text) < 0)
    own = [int(weights[a:b].sum()) for a, b in zip(surges, dives, strict=True)]
    share = max((int(total[a:b].sum()) for a, b in zip(surges, dives, strict=True)), default=0) / 5 if least > 1 else 0
    return [(int(a), int(b)) for a, b, t in zip(surges, dives, own, strict=True) if sums[a:b].max() >= least and t >= share]


def chosen(found: list[tuple[str, int, bool, int, bool]]) -> np.ndarray:
    """Which of a page's lines are main text."""
    length = np.array([len(x[0]) for x in found])
    places = np.array([x[3] for x in found])
    wanted = ~np.array([x[2] for x in found])
    links = np.array([linked > MOST_LINKED * len(text) for text, linked, *_ in found])
    # In an article or main element links may be text.
    text = np.where(wanted & (~links | (places > 0)), length, 0)
    zone = next((z for z in (2, 1) if 2 * text[places >= z].sum() > text.sum()), 0)
    keep = np.zeros(len(found), bool)
    if zone:
        inside = places >= zone
        weights = text + np.where(inside & (text > 0), max(LEAST_SURGE, int(text.sum())), 0)
        # Lines without text at the zone's edges part it from what is outside.
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        at = np.arange(len(found)) + LINES * np.searchsorted(edges, np.arange(len(found)), "right")
        spread = np.zeros((2, at[-1] + 1), np.int64)
        spread[0, at], spread[1, at] = weights, text
        for a, b in between(spread[0], LEAST_SURGE, spread[1]):
            keep[(at >= a) & (at < b)] = True
        return keep & (text > 0)
    text[links] = 0
    kept = between(text, LEAST_SURGE) or between(text, 1)
    if not kept:
        return keep
    first, last = kept[0][0], kept[-1][1]
    keep[first:last] = True
    for i in range(last, len(found)):
        keep[i] |= bool(text[i] and not places[i] and _ENDED.search(found[i][0]))
    # A heading that only links part from the text it heads.
    before = [i for i in range(first) if text[i]]
    if before and found[before[-1]][4] and not any(x[4] for x, k, t in zip(found, keep, text, strict=True) if k and t):
        keep[before[-1]] = True
    return keep & (text > 0)


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = [x for x in lines(page or "") if x[0]]
    return "\n".join(x[0] for x, k in zip(found, chosen(found), strict=True) if k) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    schema = staging.fields(page_id="bigint", url="string", text="string", n_chars="bigint")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return staging.plain(pages, {"page_id": "bigint", "url": "string", "html": "string"}).mapInArrow(rows, schema)
