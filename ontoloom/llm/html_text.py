"""HTML extraction with a host suffix array.

A page is read into blocks by a small tag scanner, which marks the zone of each (article, main or the rest of the page) and
what markup excludes: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments by tag, role,
class or id. The blocks outside marked articles of all pages of a host, token after token, make its suffix array, cut at
the `depth` tokens that a repeat must have. Spark builds it by grouping suffixes on (host, first `depth` tokens); a group
on at least two distinct pages and a `share` of the host's pages is boilerplate, its neighbours in the text extend it, and
the tokens outside are the unique runs. Blocks of marked articles enter the array whole, one suffix each, since what a site puts
into its articles are whole blocks, while articles quote and repeat passages of each other.

Every page goes through the array, which decides three things. A block of a marked article goes when it has `depth` tokens and stands in articles on most pages
of the host, unless most of the article would go: then it is a copy and stays whole. A marked article (`article`, else `main`) is the page's text unless the page has more unique tokens outside of it:
then the mark is a teaser, and the page is read as unmarked. Of an unmarked page the unique runs of all blocks that
markup does not exclude stay, the rest goes; a page without any, the copy of a whole page, keeps its blocks. Inside
a chosen article rarer repeats stay: a host may hold an article, or a passage, twice.

The grouping combines before its shuffle, so a host with a third of all pages costs no task more than others.
Suffixes are compared by 128 bits of hash.

Edge cases: null or empty html gives an empty text; null urls share one nameless host, where page_ids tell pages apart; rows with one url are
one page to the suffix array, and each row gets its own text, whatever ids repeat or are null; unclosed tags, comments and quotes are read as
browsers do in the main; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_again, whole_id, written

DEPTH = 8
SHARE = 0.05
#: A block of articles is boilerplate on more than this share of the pages of a host that has so many.
ARTICLE_SHARE, ARTICLE_PAGES = 0.5, 4

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# fixed values: HTML elements by their role in a page
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp"}
DROPPED = {"head", "nav", "footer", "aside", "form", "header", "template", "svg", "math", "canvas", "audio", "video", "select", "menu", "dialog", "map", "fieldset"}
CONTAINERS = {"html", "body", "article", "main", "div", "section", "ul", "ol", "dl", "table", "figure", "blockquote", "details", "center"} | DROPPED
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "figcaption", "pre", "hr", "address", "summary", "hgroup", "legend", "option"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
CLASSES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead",
    "comment", "comments", "respond", "disqus", "replies", "share", "sharing", "social", "related", "recommended", "widget", "pagination", "pager", "toolbar",
}


# fixed values: parts of a class name that say where or what kind of box it is, and nothing of its content
NEUTRAL = {"site", "page", "global", "main", "top", "bottom", "left", "right", "box", "container", "wrapper", "wrap", "block", "list", "bar", "section", "area", "header", "links", "link", "slot", "unit", "inner", "outer", "primary", "secondary", "items", "item"}


def _unwanted(names: str) -> bool:
    """Whether a class or id names boilerplate as a whole: `site-footer` does, `related-work` does not."""
    for name in names.split():
        parts = {x.lower() for x in _PARTS.findall(name) if not x.isdigit()}
        if parts & CLASSES and parts <= CLASSES | NEUTRAL:
            return True
    return False


def _excluded(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED:
        return tag != "header" or not in_article
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name in ("class", "id") and (tag in CONTAINERS or not in_article) and _unwanted(value):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(html: str) -> list[tuple[str, str]]:
    """(zone, text) of a page's visible blocks; zones: article, main, page, out (excluded by markup)."""
    found: list[tuple[str, str]] = []
    open_: list[tuple[str, str, bool]] = []  # tag, zone inside, excluded inside
    text: list[str] = []
    zone, out, at, n = "page", False, 0, len(html)

    def flush() -> None:
        words = unescape("".join(text)).split()
        text.clear()
        if words:
            found.append(("out" if out else zone, " ".join(words)))

    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text.append(html[at:])
            break
        text.append(html[at : m.start()])
        at = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not end:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
        elif tag == "br":
            text.append(" ")
        elif end:
            if tag in BLOCKS:
                flush()
            if tag in CONTAINERS and any(x[0] == tag for x in open_):
                while open_.pop()[0] != tag:
                    pass
                zone, out = open_[-1][1:] if open_ else ("page", False)
        elif tag in BLOCKS or _excluded(tag, attrs, zone != "page"):
            flush()
            if tag == "body":  # ends a head that nothing closed
                open_ = [x for x in open_ if x[0] == "html"]
                zone, out = "page", False
            if tag in CONTAINERS and not attrs.endswith("/"):
                out = out or _excluded(tag, attrs, zone != "page")
                zone = tag if tag in ("article", "main") and zone != "article" else zone
                open_.append((tag, zone, out))
            elif _excluded(tag, attrs, zone != "page") and not attrs.endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else at
    flush()
    return found


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, and of every visible block its text, zone and the number of its tokens."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, none, url, html in zip(pdf.page_id, pdf.none, pdf.url, pdf.html):
                got = blocks(html or "")
                zones = {z for z, _ in got}
                own = "article" if "article" in zones else "main" if "main" in zones else None
                host = re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").split("/")[0].rpartition("@")[2].lower()
                rows.append((page_id, none, url, host, [t for _, t in got], ["own" if z == own else "out" if z == "out" else "page" for z, _ in got]))
            yield pd.DataFrame(rows, columns=["page_id", "none", "url", "host", "texts", "zones"])

    got = pages.select(*whole_id("page_id"), "url", "html").mapInPandas(read, "page_id long, none boolean, url string, host string, texts array<string>, zones array<string>")
    # a row's own key, and what makes a page distinct
    got = got.withColumn("page_id", id_again("page_id")).withColumn("row", F.monotonically_increasing_id())
    return got.withColumn("page", F.xxhash64(F.coalesce("url", F.concat(F.lit("id "), F.col("page_id").cast("string")), F.concat(F.lit("row "), F.col("row").cast("string")))))


def boilerplate(pages: DataFrame, depth: int, share: float) -> DataFrame:
    """(row, covered): places in the token stream of a page's blocks outside its marked article where a repeat of `depth` tokens starts,
    and -1 - i for every block i of its article that most of the host's pages hold. Where a page shows its article only, the former are counted and not told."""
    zipped = F.arrays_zip("texts", "zones")
    outer = F.filter(zipped, lambda b: b["zones"] != "own")
    tokens = F.split(F.array_join(F.transform(outer, lambda b: b["texts"]), " "), " ")
    inner = F.filter(F.transform(zipped, lambda b, i: F.struct((-1 - i).alias("at"), b["texts"].alias("text"), b["zones"].alias("zone"))), lambda b: b["zone"] == "own")
    inner = F.filter(inner, lambda b: F.regexp_count(b["text"], F.lit(" ")) + 1 >= depth)
    block = F.transform(inner, lambda b: F.struct(b["at"].alias("at"), F.xxhash64(b["text"]).alias("x"), F.xxhash64(F.lit(1), b["text"]).alias("y"), F.lit(True).alias("own")))
    hashes = lambda i: (F.xxhash64(F.slice("tokens", i, depth)), F.xxhash64(F.lit(1), F.slice("tokens", i, depth)))
    suffix = F.transform(F.sequence(F.lit(1), F.size("tokens") - depth + 1), lambda i: F.struct((i - 1).alias("at"), hashes(i)[0].alias("x"), hashes(i)[1].alias("y"), F.lit(False).alias("own")))
    bare = ~F.array_contains("zones", "page") & F.array_contains("zones", "own")
    rows = pages.select("row", "host", "page", bare.alias("bare"), tokens.alias("tokens"), block.alias("blocks"))
    entries = F.when(F.size("tokens") >= depth, F.concat(suffix, "blocks")).otherwise(F.col("blocks"))
    rows = rows.select("row", "host", "page", "bare", F.explode(entries).alias("s")).select("row", "host", "page", "bare", "s.*")
    sizes = pages.groupBy("host").agg(F.count_distinct("page").alias("n_pages"))
    groups = rows.select("host", "own", "x", "y", "page").distinct().groupBy("host", "own", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = F.when(F.col("own"), (F.col("n_pages") >= ARTICLE_PAGES) & (F.col("n") > ARTICLE_SHARE * F.col("n_pages"))).otherwise(F.col("n") >= share * F.col("n_pages"))
    groups = groups.join(sizes, "host").where(often).select("host", "own", "x", "y")
    told = rows.where(F.col("own") | ~F.col("bare"))
    return told.join(groups, ["host", "own", "x", "y"], "left_semi").groupBy("row").agg(F.collect_set("at").alias("covered"))


def _chosen(texts: list[str], zones: list[str], starts, depth: int) -> tuple[str, str]:
    """The text of a page and the route that gave it."""
    gone = {p + k for p in starts if p >= 0 for k in range(depth)}
    size = {i: t.count(" ") + 1 for i, (t, z) in enumerate(zip(texts, zones)) if z == "own"}
    kept = {i: n for i, n in size.items() if -1 - i not in starts}
    if 2 * sum(kept.values()) < sum(size.values()):  # repeated for the most part: a copy of an article
        kept = size
    runs, at, fresh = [], 0, 0
    for i, (text, zone) in enumerate(zip(texts, zones)):
        if zone == "own":
            if i in kept:
                runs.append(text)
            continue
        words = text.split(" ")
        left = [w for k, w in enumerate(words, at) if k not in gone]
        at += len(words)
        if zone == "page" and left:
            fresh += len(left)
            runs.append(" ".join(left))
    if size and sum(size.values()) >= fresh:
        return "\n".join(texts[i] for i in kept), "marked"
    if runs:
        return "\n".join(runs), "unique"
    return "\n".join(t for t, z in zip(texts, zones) if z == "page"), "copy"


def routed(pages: DataFrame, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """page_id, url, text and route (marked, unique or copy) of every page."""
    got = written(parsed(pages), "zstd")
    # written, so that Spark knows its size and need not move texts to few repeats
    rows = got.join(written(boilerplate(got, depth, share)), "row", "left")

    @F.pandas_udf("text string, route string")
    def choose(texts: pd.Series, zones: pd.Series, covered: pd.Series) -> pd.DataFrame:
        out = [_chosen(t, z, set(c.tolist()) if isinstance(c, np.ndarray) else (), depth) for t, z, c in zip(texts, zones, covered)]
        return pd.DataFrame(out, columns=["text", "route"])

    return rows.select("page_id", "url", choose("texts", "zones", "covered").alias("c")).select("page_id", "url", "c.*")


def extract(pages: DataFrame, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return routed(pages, depth, share).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
