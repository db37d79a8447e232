"""Scalar text expressions: strip, combine, coerce, truncate, preview, URL tests.

Everything here is a native Spark expression, so it stays inside the scan stage.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from credlake.config import DEFAULTS, FAKE, LABEL_NAMES, REAL

# The code points Python counts as white space: the characters themselves (for
# trimming) and the body of a regex class. Java's \s knows only the ASCII ones.
SPACE_CHARS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
#
# Single Latin-1 characters compile to a bit table; the few others sit behind one range
# test, so ordinary characters are rejected at once.
_WIDE_SPACES = "".join(f"\\x{{{ord(char):X}}}" for char in SPACE_CHARS if ord(char) > 0xFF)
SPACE_CLASS = (
    "".join(f"\\x{{{ord(char):X}}}" for char in SPACE_CHARS if ord(char) <= 0xFF)
    + f"[\\x{{1680}}-\\x{{3000}}&&[{_WIDE_SPACES}]]"
)

# Label words.
FAKE_WORDS = ["fake", "false", "unreliable"]
REAL_WORDS = ["real", "true", "reliable"]

# Fixed value: the URL shape accepted as input.
URL_PATTERN = (
    r"(?i)^https?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?"
    r"|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?(?:/?|[/?][^" + SPACE_CLASS + r"]+)\n?\z"
)

NUMBER_PATTERN = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Optimizer rules that move expressions copy them for every reference; bound to a
    lambda variable, a costly value is referred to only once.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends (plain ``trim`` knows only blanks)."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only strings."""
    return F.coalesce(~col.rlike(f"[^{SPACE_CLASS}]"), F.lit(True))


def split_words(col: Column) -> Column:
    """Words between runs of white space; an empty array for a blank string."""
    return F.when(is_blank(col), F.array().cast("array<string>")).otherwise(
        F.split(strip(col), f"[{SPACE_CLASS}]+")
    )


def contains_any(col: Column, words: list[str]) -> Column:
    """Substring test against a short ordered word list."""
    test = F.lit(False)
    for word in words:
        test = test | col.contains(word)
    return test


def combine_title_text(title: Column, text: Column) -> Column:
    """``title. text`` when both are present, else whichever is, else ''."""
    title = F.coalesce(strip(title), F.lit(""))
    text = F.coalesce(strip(text), F.lit(""))
    both = (title != "") & (text != "")
    return F.when(both, F.concat(title, F.lit(". "), text)).otherwise(F.concat(title, text))


def coerce_label(value: Column) -> Column:
    """Label text to 1 (FAKE), 0 (REAL) or null.

    Numbers win over words. The regex guard keeps Java-only forms such as ``1d``
    from being read as numbers.
    """
    key = F.lower(strip(value.cast("string")))
    number = F.when(key.rlike(NUMBER_PATTERN), key.try_cast("double"))
    return (
        F.when(number == 1.0, F.lit(FAKE))
        .when(number == 0.0, F.lit(REAL))
        .when(number.isNotNull(), F.lit(None).cast("int"))
        .when(key.isin(FAKE_WORDS), F.lit(FAKE))
        .when(key.isin(REAL_WORDS), F.lit(REAL))
    )


def decode_label(label: Column) -> Column:
    """0/1 to REAL/FAKE."""
    return F.when(label == FAKE, LABEL_NAMES[FAKE]).when(label == REAL, LABEL_NAMES[REAL])


def truncate(col: Column, max_chars: int = DEFAULTS.max_input_chars) -> Column:
    """First ``max_chars`` code points."""
    return F.substring(col, 1, max_chars)


def confidence_level(
    confidence: Column,
    high: float = DEFAULTS.high_confidence,
    medium: float = DEFAULTS.medium_confidence,
) -> Column:
    """High / Medium / Low on the unrounded score, Unknown for null and NaN."""
    return (
        F.when(confidence.isNull() | F.isnan(confidence), "Unknown")
        .when(confidence >= high, "High")
        .when(confidence >= medium, "Medium")
        .otherwise("Low")
    )


def safe_preview(col: Column, max_chars: int = 40) -> Column:
    """Redacted preview: prefix, length and hash prefix, never the whole text."""
    head = F.replace(F.substring(col, 1, max_chars), F.lit("\n"), F.lit(" "))
    dots = F.when(F.length(col) > max_chars, "...").otherwise("")
    shown = F.format_string(
        "'%s%s' (len=%d, sha256=%s)", head, dots, F.length(col), F.substring(F.sha2(col, 256), 1, 10)
    )
    return F.when(F.coalesce(col, F.lit("")) == "", "<empty>").otherwise(shown)


def history_preview(col: Column, max_chars: int = 200) -> Column:
    """Text as listed on a history page."""
    return F.substring(col, 1, max_chars)


def is_url(col: Column) -> Column:
    """True for an http(s) URL with a host name, localhost or an IPv4 address."""
    return F.coalesce(col.rlike(URL_PATTERN), F.lit(False))


def detect_input_type(text: Column, url: Column | None = None) -> Column:
    """url / article / claim, by the URL argument first and then by word count."""
    body = strip(text)
    words = F.size(split_words(body))
    by_text = (
        F.when(words > 100, "article")
        .when(words > 5, "claim")
        .when(is_url(body), "url")
        .otherwise("claim")
    )
    if url is None:
        return by_text
    return F.when(is_url(url), "url").otherwise(by_text)


def verification_text(title: Column, text: Column) -> Column:
    """Text of a page to verify: title in front only when there is one."""
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(
        F.concat(title, F.lit(". "), text)
    )


def scan_text(title: Column, snippet: Column) -> Column:
    """Text of a scanned article: always joined."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(snippet, F.lit("")))


def content_digest(content: Column) -> Column:
    """32-byte key of a text: grouping on it keeps whole texts out of shuffle keys."""
    return F.unhex(F.sha2(content, 256))


def hash_bucket(key: Column, seed: int | str, buckets: int = 10000) -> Column:
    """Repeatable bucket of a key; the same arithmetic works in plain SQL."""
    return F.pmod(hash_number(key, seed), F.lit(buckets)).cast("int")


def hash_number(key: Column, seed: int | str) -> Column:
    """32 hash bits of seed and key as a long."""
    digest = F.md5(F.concat(F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
