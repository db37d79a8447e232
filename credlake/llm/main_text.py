"""Main text of web pages: declared structure, and a host suffix array for what isn't declared.

A page is read once, tag by tag. Parts that are no article by their element or by a word of
their class, id or role (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments) are set apart. If the page declares an article or a main part, that is the
text, whole: an article's passages may well occur on other pages too. An article element that
its class, id or role calls a comment, a reply or a teaser is set apart as other elements are.

A page that declares nothing is judged by its host. The blocks of the host's pages (all text
outside declared articles) are cut into suffixes, ordered by their first ``LONG`` words; a block
of ``SHORT`` words up to that length counts whole. What stands on a ``SHARE`` of the host's
distinct pages, a whole block on two at least and a run on ``RUN_PAGES``, is repeated text; overlapping runs add up to the whole
repeated passage, so it ends where the pages part. It is removed from undeclared pages and the
rest is kept: phrases, and passages that only some pages share, are the pages' own text.
Ordering is done by grouping on (host, prefix), which adds up before the shuffle, so neither a
large host nor a line that all its pages share gathers in one task.

Defined results: null and empty html give the empty text; unclosed and stray tags are
passed over; a quote that no closing quote ends in its tag is part of the tag; repeated rows get equal texts, and pages of equal ids or equal html count as one; a null url is a host of its
own name; an empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import word_hashes, written
from credlake.llm.passages import hashed_runs

LONG = 12
SHORT = 5
SHARE = 0.3
RUN_PAGES = 3

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"(?=[\s/>]|[a-zA-Z-]+=)|'[^']*'(?=[\s/>]|[a-zA-Z-]+=))*|[^<>]*)/?>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "canvas", "audio", "video", "select"}
_APART = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "newsletter", "subscribe", "subscription", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "header", "masthead", "footer", "copyright",
    "comment", "comments", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "popup", "modal", "overlay", "widget", "login", "signup", "search", "complementary", "contentinfo",
}
_NO_ARTICLE = {"comment", "comments", "reply", "respond", "related", "recommended", "teaser", "promo", "sponsored", "ad", "advert", "advertisement"}
_STATES = {"open", "closed", "has", "no", "with", "without"}  # "comments-open" tells of an article, not of a comment
_AD = re.compile(r"ads?(?:box|slot|unit|block|space|container|wrapper|frame|area|zone|bar|sense)s?")
_CLOSES_P = {"p", "div", "article", "section", "main", "ul", "ol", "li", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "aside", "form", "hr", "dl", "figure", "fieldset"}


def _attributes(attributes: str) -> list[tuple[str, str]]:
    """(name, value) of each attribute, both lower-cased; values are read whole, so no name is found inside one."""
    return [(name.lower(), (a or b or c).lower()) for name, a, b, c in _ATTRIBUTE.findall(attributes)]


def _set_apart(tag: str, attributes: str) -> bool:
    if tag in _APART:
        return True
    for name, value in _attributes(attributes):
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true":
            return True
        if name in ("class", "id", "role") and tag not in ("body", "html", "main"):
            names = [re.split(r"[_-]+", n) for n in value.split()]
            if tag == "article":
                names = [n for n in names if _STATES.isdisjoint(n)]
            apart = _NO_ARTICLE if tag == "article" else _WORDS
            if any(w in apart or _AD.fullmatch(w) for n in names for w in n):
                return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) in page order; kind 2: in a declared article, 1: in a declared main part, 0: elsewhere, -1: set apart."""
    if not page:
        return []
    out: list[tuple[int, str]] = []
    text: list[str] = []
    open_: list[tuple[str, bool, int]] = []  # (tag, set apart, declared)
    apart, declared = 0, 0

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((-1 if apart else declared, joined))

    def close(depth: int) -> None:
        nonlocal apart, declared
        flush()
        while len(open_) > depth:
            apart -= open_.pop()[1]
        declared = max((d for _, _, d in open_), default=0)

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if not tag:
            text.append(page[at:])
            break
        text.append(page[at : tag.start()])
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if tag.group(1):
            if name not in _INLINE:
                flush()
                depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
                if depth is not None:
                    close(depth)
            elif any(o[0] == name and o[1] for o in open_):
                close(max(k for k, o in enumerate(open_) if o[0] == name and o[1]))
            continue
        if name in _RAW:
            if not tag.group(0).endswith("/>"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if name not in ("title",):
                    text.append("")
                at = end.end() if end else len(page)
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name in _INLINE:
            if tag.group(3) and _set_apart(name, tag.group(3)):
                flush()
                open_.append((name, True, 0))
                apart += 1
            continue
        flush()
        if name in _CLOSES_P:
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == "p"), None)
            if depth is not None and all(o[0] == "p" or o[0] in _INLINE for o in open_[depth:]):
                close(depth)
        hide = _set_apart(name, tag.group(3) or "")
        kind = 2 if name == "article" else 1 if name == "main" or any(n == "role" and "main" in v.split() for n, v in _attributes(tag.group(3) or "")) else 0
        if name in ("body", "html"):
            continue
        open_.append((name, hide, kind))
        apart += hide
        declared = max(declared, kind)
    flush()
    return out


def article(found: list[tuple[int, str]]) -> str | None:
    """The declared text, or None where nothing is declared."""
    best = max((k for k, _ in found), default=0)
    return " ".join(t for k, t in found if k == best) if best > 0 else None


def named_hosts(pages: DataFrame) -> DataFrame:
    """(host, page_id, page, content, html) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(host.alias("host"), "page_id", F.xxhash64("page_id", "html").alias("page"), F.xxhash64("html").alias("content"), "html")


def suffixes(pages: DataFrame) -> DataFrame:
    """(host, prefix, page_id, page, content, pos, size): suffixes of each page's blocks outside its article, and short blocks; pos is -1 where the page has a declared text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prefixes, places, sizes = [], [], [], []
            for i, page in enumerate(batch.column(4).to_pylist()):
                found = blocks(page)
                free = article(found) is None
                start = 0
                for kind, text in found:
                    if kind > 0:
                        continue
                    words = word_hashes(text.encode())
                    if len(words) >= SHORT:
                        size = min(len(words), LONG)
                        h = hashed_runs(words, size)
                        prefixes.append(h.astype(np.int64))
                        places.append(np.arange(start, start + len(h)) if free and kind == 0 else np.full(len(h), -1))
                        rows.append(np.full(len(h), i))
                        sizes.append(np.full(len(h), size))
                    start += len(words) if kind == 0 else 0
            if rows:
                at = pa.array(np.concatenate(rows))
                host, page_id, page, content = (batch.column(k).take(at) for k in range(4))
                yield pa.record_batch([host, pa.array(np.concatenate(prefixes)), page_id, page, content, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32))], ["host", "prefix", "page_id", "page", "content", "pos", "size"])

    rows = named_hosts(pages)
    return rows.mapInArrow(run, f"host string, prefix bigint, page_id {dict(rows.dtypes)['page_id']}, page bigint, content bigint, pos int, size int")


def n_pages(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, n): distinct pages, those of equal html or equal ids taken as one."""
    one = rows.groupBy(*by, "content").agg(F.min("page_id").alias("low"))
    return one.groupBy(*by).agg(F.count_distinct("low").alias("n"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, declared, n_removed) of every page."""
    stream = written(suffixes(pages), "suffixes")
    hosts = n_pages(named_hosts(pages), "host").withColumnRenamed("n", "of")
    least = F.when(F.col("size") < LONG, 2).otherwise(RUN_PAGES)
    repeated = n_pages(stream, "host", "prefix", "size").where(F.col("n") >= least).join(hosts, "host").where(F.col("n") >= SHARE * F.col("of")).select("host", "prefix")
    covered = stream.where("pos >= 0").join(repeated, ["host", "prefix"]).groupBy("page").agg(F.collect_set(F.struct("pos", "size")).alias("covered"))
    covered = written(covered, "covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, declared, removed = [], [], []
            for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = blocks(page)
                text = article(found)
                declared.append(text is not None)
                n = 0
                if text is None:
                    words = [w for k, t in found if k == 0 for w in t.split(" ")]
                    hide = {r["pos"] + k for r in gone or () for k in range(r["size"])}
                    n = len(hide)
                    text = " ".join(w for k, w in enumerate(words) if k not in hide)
                texts.append(text)
                removed.append(n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(declared), pa.array(removed, pa.int32())], ["page_id", "url", "text", "n_chars", "declared", "n_removed"])

    rows = pages.select("page_id", "url", "html", F.xxhash64("page_id", "html").alias("page")).join(covered, "page", "left").select("page_id", "url", "html", "covered")
    kinds = dict(pages.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, declared boolean, n_removed int")
