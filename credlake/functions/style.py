"""Stylistic features of the raw text, as native expressions.

Counts are taken as length differences after deleting characters, which needs no
array of matches and stays linear on long texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.config import NUMERIC_FEATURES
from credlake.functions.cleaning import URL_PATTERN
from credlake.functions.text import SPACE_CLASS, strip

# The ASCII punctuation marks that are counted.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Fixed value: a sentence ends at these marks before white space or the end.
SENTENCE_END = f"[.!?]+(?:[{SPACE_CLASS}]|\\z)"


# The marks as single characters of a class, which compiles to a bit table.
PUNCTUATION_PATTERN = "[" + "".join("\\" + mark for mark in PUNCTUATION) + "]+"


def sentence_count(col: Column) -> Column:
    pieces = F.filter(F.split(col, SENTENCE_END), lambda s: s.rlike(f"[^{SPACE_CLASS}]"))
    return F.greatest(F.size(pieces), F.lit(1))


def punctuation_count(col: Column) -> Column:
    return F.length(col) - F.length(F.regexp_replace(col, PUNCTUATION_PATTERN, ""))


def url_count(col: Column) -> Column:
    possible = col.contains("http") | col.contains("www.")
    return F.when(possible, F.regexp_count(col, F.lit(URL_PATTERN))).otherwise(0)


def mark_count(col: Column, mark: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(mark), F.lit("")))


def with_style(df: DataFrame, content: str = "content") -> DataFrame:
    """Add the nine features in fixed order; blank text gives all 0.0.

    Two projections: the first flattens white space and picks the letters once, the
    second counts in these shorter strings.
    """
    col = F.coalesce(F.col(content), F.lit(""))
    staged = df.withColumns(
        {
            "__flat": F.regexp_replace(strip(col), f"[{SPACE_CLASS}]+", " "),
            "__alpha": F.regexp_replace(col, r"[^\p{L}]+", ""),
        }
    )
    flat, alpha = F.col("__flat"), F.col("__alpha")
    solid = F.length(F.replace(flat, F.lit(" "), F.lit("")))
    words = F.length(flat) - solid + 1
    upper = F.length(F.regexp_replace(alpha, r"[^\p{Lu}]+", ""))
    values = {
        "word_count": words,
        "char_count": F.length(col),
        "sentence_count": sentence_count(col),
        "avg_word_length": F.round(solid / words, 4),
        "uppercase_ratio": F.when(alpha == "", 0.0).otherwise(F.round(upper / F.length(alpha), 4)),
        "punctuation_count": punctuation_count(col),
        "url_count": url_count(col),
        "exclamation_count": mark_count(col, "!"),
        "question_count": mark_count(col, "?"),
    }
    features = {
        name: F.when(flat == "", F.lit(0.0)).otherwise(values[name].cast("double"))
        for name in NUMERIC_FEATURES
    }
    return staged.withColumns(features).drop("__flat", "__alpha")
