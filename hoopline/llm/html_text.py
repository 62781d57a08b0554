"""Main text of web pages as the maximum-scoring run of words and tags.

A page is read as a sequence of tags and words. Each has a weight that depends on its kind and on the nearest container
around it (an element with a meaning of its own: article, nav, a div with a class, ...): words of content score above
zero, words of boilerplate and all tags below (boilerplate inside an article counts nothing). One linear scan finds the run with the largest sum; the text of that run,
without the boilerplate containers inside it, is the main text.

The weights are log odds counted on labelled pages: a bounded sample (about ``LABELLED_PAGES`` pages of at most
``LABELLED_CHARS`` characters, lowest hash of the id first) of pages that mark their content with ``article`` or
``main``. Kinds not seen there, and tables without such pages, take the default weights; so does the plain body of a page without text in ``article`` or
``main``, of which marked pages say nothing.

Null or empty html gives an empty text. Repeated rows and ids are independent of each other. Open comments, tags
and elements end with the page. Very long pages are read whole. An empty table gives no rows. Only page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.llm.common import hash_sample, read_table

LABELLED_PAGES = 1000
LABELLED_CHARS = 50_000

# Elements and class or id words of pages.
CONTENT_ELEMENTS = {"article", "main"}
BOILERPLATE_ELEMENTS = {
    "head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas",
    "select", "button", "textarea", "dialog", "menu", "audio", "video", "map", "math", "title", "fieldset", "datalist",
}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "promo", "promotion", "sponsor", "sponsored", "outbrain", "taboola",
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "skip", "toc",
    "header", "masthead", "footer", "sidebar", "aside", "widget", "widgets", "copyright", "colophon",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "disclaimer", "paywall",
    "comment", "comments", "disqus", "reply", "replies", "respond", "commentlist",
    "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login", "form", "search", "related", "recommended", "recommendations", "trending", "teaser", "teasers",
    "contentinfo", "complementary", "dialog", "hidden",
}
RAW_ELEMENTS = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID_ELEMENTS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK_ELEMENTS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p",
    "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
# Elements that end where the next of them begins, and what stops the search for the open one.
ENDS_BEFORE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
KEEPS_P_OPEN = {"br", "option", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "title"}

# Boilerplate is left out of the text anyway; where it stands inside marked content it must not cut the run in two.
WORD, TAG = 1.0, -0.05
BOILERPLATE_WORD, BOILERPLATE_TAG = -0.2, -0.5
MOST = 8.0

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
Token = tuple[str, str, bool, str]  # kind of tag or "", container, container is boilerplate, text


def _container(name: str, attributes: str) -> tuple[str, bool] | None:
    """Name of the container that this tag opens and whether it is boilerplate; None if it opens none."""
    names: set[str] = set()
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            names |= {"hidden"} if m[1].lower() == "hidden" else {p.lower() for p in NAME_PARTS.findall(m[2] or m[3] or m[4] or "")}
    if name in BOILERPLATE_ELEMENTS or (name not in ("html", "body") and name not in CONTENT_ELEMENTS and names & BOILERPLATE_WORDS):
        return ".".join([name, *sorted(names & BOILERPLATE_WORDS)]), True
    return (name, False) if name in CONTENT_ELEMENTS or name == "body" else None


def tokens(page: str) -> Iterator[Token]:
    """The page's tags and text runs in order; a run of text is one token of as many words as it has."""
    at, end = 0, len(page)
    stack: list[tuple[str, str, bool]] = [("", "", False)]
    open_names: Counter[str] = Counter()

    def pop_to(names: set[str], stop: set[str]) -> None:
        if any(open_names[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    for x in stack[k:]:
                        open_names[x[0]] -= 1
                    del stack[k:]
                    return
                if stack[k][0] in stop:
                    return

    while at < end:
        m = MARKUP.search(page, at)
        if (m.start() if m else end) > at:
            yield "", stack[-1][1], stack[-1][2], page[at : m.start() if m else end]
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            pop_to({name}, {"article", "body"} - {name} if name in ("p", "li", "b", "i", "a", "span") else set())
            yield "/" + name, stack[-1][1], stack[-1][2], ""
            continue
        if name in BLOCK_ELEMENTS and name not in KEEPS_P_OPEN:
            pop_to({"p"}, {"article", "body", "div", "section", "td", "button", "aside", "nav", "footer", "header", "form"})
        if name in ENDS_BEFORE:
            pop_to(*ENDS_BEFORE[name])
        if name == "body":
            pop_to({"head"}, set())
        yield name, stack[-1][1], stack[-1][2], ""
        attributes = m[3] or m[6] or ""
        if name in VOID_ELEMENTS or (attributes.endswith("/") and name in ("svg", "path", "object")):
            continue
        if name in RAW_ELEMENTS:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        own = _container(name, attributes)
        around, inside = stack[-1][1:]
        if inside:
            own = None
        elif own and own[1] and around in CONTENT_ELEMENTS:
            own = (">" + own[0], True)
        stack.append((name, own[0] if own else around, inside or bool(own and own[1])))
        open_names[name] += 1


def _weight(weights: dict[tuple[str, str], float], kind: str, container: str, boilerplate: bool, marked: bool) -> float:
    if container.startswith(">"):
        return 0.0
    known = weights.get((kind, container)) if marked or boilerplate else None
    if boilerplate:
        return min(known if known is not None else 0.0, BOILERPLATE_TAG if kind else BOILERPLATE_WORD)
    if known is None:
        return TAG if kind else WORD
    return min(known, TAG) if kind else known


def learn_weights(pages: list[str]) -> dict[tuple[str, str], float]:
    """Log odds of each kind inside and outside the marked content of ``pages``."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for kind, container, boilerplate, text in tokens(page):
            n = 1 if kind else len(text.split())
            if n:
                content = not boilerplate and container in CONTENT_ELEMENTS and kind not in CONTENT_ELEMENTS and kind.removeprefix("/") not in CONTENT_ELEMENTS
                (inside if content else outside)[kind, container] += n
    return {k: max(-MOST, min(MOST, math.log((inside[k] + 0.5) / (outside[k] + 0.5)))) for k in inside | outside}


def main_text(page: str, weights: dict[tuple[str, str], float]) -> str:
    """Text of the best run of ``page``: blocks in page order, joined by one space."""
    run = list(tokens(page))
    marked = any(not kind and container in CONTENT_ELEMENTS and not boilerplate and text.strip() for kind, container, boilerplate, text in run)
    best, best_start, best_end = 0.0, 0, 0
    total, start = 0.0, 0
    for k, (kind, container, boilerplate, text) in enumerate(run):
        n = 1 if kind else len(text.split())
        if n:
            total += n * _weight(weights, kind, container, boilerplate, marked)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, best_start, best_end = total, start, k + 1
    out = []
    for kind, _, boilerplate, text in run[best_start:best_end]:
        if not kind:
            if not boilerplate:
                out.append(html.unescape(text))
        elif kind.removeprefix("/") in BLOCK_ELEMENTS:
            out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text, n_chars. ``labelled`` (html) defaults to a sample of the pages."""
    if labelled is None:
        marked = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= LABELLED_CHARS))
        labelled = hash_sample(marked.select("html", "page_id"), ["page_id", "html"], LABELLED_PAGES).select("html")
    weights = learn_weights([r["html"] for r in labelled.collect()])

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(page or "", weights) for page in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": found, "n_chars": [len(t) for t in found]})

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(texts, f"page_id {id_type}, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read_table(spark, sf_dir, "pages"))
