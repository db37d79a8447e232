"""Article extraction from a table of raw pages, with native string functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.functions.cleaning import unescape
from credlake.functions.text import let, strip

MAX_ARTICLE_CHARS = 50000
# Marks that replace tags while paragraphs are cut out; control characters that do
# not occur in valid HTML.
PARAGRAPH, END, NODE = "\x01", "\x02", "\x03"
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
PARAGRAPH_START = r"(?i)<p(?:\s[^>]*)?>"
TAG = r"<[/!?A-Za-z][^>]*(?:>|\z)"
# Tags that end an open paragraph.
BLOCKS = (
    "address|article|aside|blockquote|body|center|dir|div|dl|fieldset|figure|footer|form|h[1-6]|"
    "header|hr|html|main|menu|nav|ol|pre|section|table|ul"
)
PARAGRAPH_END = rf"(?i)</p\s*>|</?(?:{BLOCKS})(?:\s[^>]*)?>"


def cap_html(html: Column, max_chars: int = MAX_ARTICLE_CHARS) -> Column:
    """Raw page cut at ten times the article limit."""
    return F.substring(html, 1, max_chars * 10)


def _meta_content(html: Column, attribute: str, name: str) -> Column:
    """Raw content of the first meta tag with the attribute value; null when absent."""
    pattern = rf"(?is)<meta\b(?=[^>]*\b{attribute}\s*=\s*[\"']?{name}[\"'\s/>])[^>]*>"
    content = r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"

    def read(tag: Column) -> Column:
        values = F.concat(F.regexp_extract(tag, content, 1), F.regexp_extract(tag, content, 2))
        return F.when(tag.rlike(content), values)

    return let(F.regexp_extract(html, pattern, 0), read)


def title_tag(html: Column) -> Column:
    """Raw text of the title tag, '' when there is none."""
    return F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)


def with_head_fields(df: DataFrame, html: str = "html") -> DataFrame:
    """Add title (og:title before the title tag), author and date, '' when absent.

    The raw values are their own projection, because decoding refers to them twice.
    """
    page = F.col(html)
    raw = df.withColumns(
        {
            "__tag": title_tag(page),
            "__og": _meta_content(page, "property", "og:title"),
            "__author": _meta_content(page, "name", "author"),
            "__date": _meta_content(page, "property", "article:published_time"),
        }
    )
    fields = {
        "title": F.coalesce(unescape(F.col("__og")), strip(unescape(F.col("__tag")))),
        "author": F.coalesce(unescape(F.col("__author")), F.lit("")),
        "date": F.coalesce(unescape(F.col("__date")), F.lit("")),
    }
    return raw.withColumns(fields).drop("__tag", "__og", "__author", "__date")


def marked_paragraphs(html: Column) -> Column:
    """Page with tags replaced by marks; character references still encoded."""
    visible = F.regexp_replace(F.translate(html, PARAGRAPH + END + NODE, ""), HIDDEN, "")
    marked = F.regexp_replace(F.regexp_replace(visible, PARAGRAPH_START, PARAGRAPH), PARAGRAPH_END, END)
    return F.regexp_replace(marked, TAG, NODE)


def paragraph_texts(marked: Column) -> Column:
    """Paragraph texts in order: each text node stripped, nodes joined without space."""

    def text(piece: Column) -> Column:
        nodes = F.split(F.substring_index(piece, END, 1), NODE)
        return F.array_join(F.transform(nodes, strip), "")

    pieces = let(F.split(marked, PARAGRAPH), lambda p: F.slice(p, F.lit(2), F.size(p)))
    return F.transform(pieces, text)


def article_rows(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(url, title, author, date, text, success) of every page, plus other columns; pages are read whole unless ``max_chars`` is given."""
    others = [c for c in pages.columns if c not in ("html", "url")]
    capped = pages if max_chars is None else pages.withColumn("html", cap_html(F.col("html"), max_chars))
    marked = with_head_fields(capped).withColumn("__marked", marked_paragraphs(F.col("html")))
    decoded = marked.withColumn("__marked", unescape(F.col("__marked")))
    long_enough = F.filter(paragraph_texts(F.col("__marked")), lambda p: F.length(p) > 50)
    text = F.array_join(long_enough, "\n\n")
    return decoded.select(
        *others,
        "url",
        "title",
        "author",
        "date",
        (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"),
        F.lit(True).alias("success"),
    )


def media_rows(df: DataFrame, images: str = "images", limit: int = 5) -> DataFrame:
    """Media rows of the first five image URLs of each request; none is marked reused."""
    first = F.slice(F.col(images), 1, limit)
    return df.select("request_id", F.posexplode(first).alias("position", "url")).select(
        F.md5(F.concat_ws("|", F.col("request_id").cast("string"), F.col("position").cast("string"))).alias(
            "media_id"
        ),
        "request_id",
        "position",
        F.lit("image").alias("media_type"),
        "url",
        F.lit(False).alias("is_reused"),
    )
