"""Text cleaning: Unicode fix, mark-up removal, token filter.

All steps are native expressions except NFKC and general entity decoding, which
Spark has no built-in for. Those run in one Arrow UDF that only receives the rows
that can change under them; every other row passes a null across.
"""
from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credlake.config import CleaningConfig
from credlake.functions.text import SPACE_CLASS, contains_any, let

# Clean-up patterns (the white-space class is spelled out).
TAG_PATTERN = r"<[^>]+>"
URL_PATTERN = f"https?://[^{SPACE_CLASS}]+|www\\.[^{SPACE_CLASS}]+"
WORD = r"[\p{L}\p{N}_]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
EMAIL_PATTERN = (
    EDGE + r"[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+" + EDGE
)

# The built-in stop words.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be
because been before being below between both but by can't cannot could
couldn't did didn't do does doesn't doing don't down during each few for
from further had hadn't has hasn't have haven't having he he'd he'll he's
her here here's hers herself him himself his how how's i i'd i'll i'm
i've if in into is isn't it it's its itself let's me more most mustn't
my myself no nor not of off on once only or other ought our ours
ourselves out over own same shan't she she'd she'll she's should
shouldn't so some such than that that's the their theirs them themselves
then there there's these they they'd they'll they're they've this those
through to too under until up very was wasn't we we'd we'll we're we've
were weren't what what's when when's where where's which while who who's
whom why why's with won't would wouldn't you you'd you'll you're you've
your yours yourself yourselves
""".split()

# Entities the native replace chain covers; '&amp;' comes last so that its result
# is not decoded a second time.
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")]
OTHER_ENTITY = r"&(?!(?:amp|lt|gt|quot|apos|#39);)[#A-Za-z]"


def _stable_class() -> str:
    """Regex class body of characters NFKC leaves alone in any neighbourhood.

    Built by rule over common blocks; whatever is not in it is sent to the UDF,
    so leaving a character out costs time and never correctness.
    """
    blocks = [(0x80, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x20A0, 0x20BF), (0x3041, 0x30FF)]
    ranges: list[list[int]] = [[0x00, 0x7F]]
    for low, high in blocks:
        for code in range(low, high + 1):
            char = chr(code)
            if unicodedata.normalize("NFKC", char) != char or unicodedata.combining(char):
                continue
            if ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    ranges += [[0x4E00, 0x9FFF], [0xAC00, 0xD7A3], [0x1F300, 0x1FAFF]]
    return "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges)


NFKC_STABLE = _stable_class()


def _arrow_udf(fix):
    """Arrow UDF on strings. It is declared non-deterministic only so that the
    optimizer never evaluates it twice (no filter is moved through it)."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fix, na_action="ignore")

    return run.asNondeterministic()


_nfkc_unescape = _arrow_udf(lambda t: html.unescape(unicodedata.normalize("NFKC", t)))
_unescape = _arrow_udf(html.unescape)


def replace_xml_entities(col: Column) -> Column:
    """Decode the XML entities natively."""
    for entity, char in XML_ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def _has_other_entity(col: Column) -> Column:
    return col.contains("&") & col.rlike(OTHER_ENTITY)


def unescape(col: Column) -> Column:
    """Decode character references; only unusual ones leave the JVM. Pass a plain
    column: it is referred to more than once."""
    special = F.when(_has_other_entity(col), col)
    return F.coalesce(_unescape(special), replace_xml_entities(col))


def normalize_unicode(col: Column) -> Column:
    """NFKC and then character references; only rows that need it leave the JVM. Pass
    a plain column: it is referred to more than once."""
    # the plain Latin test comes first; only texts beyond it meet the long class
    unstable = col.rlike(r"[^\x00-\x7F\xC0-\xFF]") & col.rlike(f"[^{NFKC_STABLE}]")
    special = F.when(unstable | _has_other_entity(col), col)
    return F.coalesce(_nfkc_unescape(special), replace_xml_entities(col))


def _replace_where(col: Column, marks: list[str], pattern: str) -> Column:
    """Replace a pattern by a blank in texts that hold one of the marks it needs."""
    return let(
        col,
        lambda c: F.when(contains_any(c, marks), F.regexp_replace(c, pattern, " ")).otherwise(c),
    )


def strip_tags(col: Column) -> Column:
    return _replace_where(col, ["<"], TAG_PATTERN)


def strip_urls(col: Column) -> Column:
    return _replace_where(col, ["http", "www."], URL_PATTERN)


def strip_emails(col: Column) -> Column:
    return _replace_where(col, ["@"], EMAIL_PATTERN)


def normalize_text(col: Column, cfg: CleaningConfig = CleaningConfig()) -> Column:
    """Native part of the cleaner up to the token split: mark-up out, case and
    characters folded, white space collapsed."""
    out = F.coalesce(col, F.lit(""))
    if cfg.remove_html:
        out = strip_tags(out)
    if cfg.remove_urls:
        out = strip_urls(out)
    if cfg.remove_emails:
        out = strip_emails(out)
    if cfg.lowercase:
        out = F.lower(out)
    if cfg.strip_non_alphanumeric:
        return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(out, f"[{SPACE_CLASS}]+", " "))


def clean_tokens(normalized: Column, cfg: CleaningConfig = CleaningConfig()) -> Column:
    """Tokens of a normalised text without stop words and one-character tokens."""

    def keep(token: Column) -> Column:
        long_enough = F.length(token) >= 2
        if not cfg.remove_stopwords:
            return long_enough
        return long_enough & ~token.isin(STOPWORDS)

    return F.filter(F.split(normalized, " "), keep)


def clean_text_tokens(clean: Column, cfg: CleaningConfig = CleaningConfig()) -> Column:
    """Tokens the vectoriser sees in a cleaned text: words of two characters or more."""
    if cfg.strip_non_alphanumeric:
        return F.filter(F.split(clean, " "), lambda t: F.length(t) >= 2)
    return F.regexp_extract_all(clean, F.lit(WORD + "{2,}"), F.lit(0))
