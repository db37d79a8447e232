"""URL and source-type rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credlake.functions.text import contains_any

# Host-name rules of the pipeline, in the order they are tested.
PIPELINE_GOVERNMENT = [".gov", ".mil", "govt", "government"]
PIPELINE_FACT_CHECK = ["factcheck", "politifact", "snopes", "reuters", "ap.org"]
PIPELINE_EDUCATION = [".edu", ".ac.uk", "university", "institute"]
PIPELINE_NEWS = [
    "news", "bbc", "cnn", "reuters", "associated-press", "theguardian", "nytimes", "washingtonpost",
]
# Host-name rules of the analyzer, in the order they are tested.
ANALYZER_GOVERNMENT = [".gov", ".mil", "gov.", "government"]
ANALYZER_EDUCATION = [".edu", ".ac.uk", ".ac.jp", ".edu.au"]
ANALYZER_FACT_CHECK = [
    "factcheck.org", "politifact.com", "snopes.com", "reuters.com", "ap.org", "bbc.com", "npr.org",
    "apnews.com",
]
ANALYZER_ORGANISATIONS = ["who.int", "un.org", "imf.org", "worldbank.org", "nasa.gov", "nih.gov"]


def domain(url: Column) -> Column:
    """Lower-case authority of a URL (port and user info kept), '' when there is none.

    A plain pattern, because Java's URI class rejects many URLs seen on the web.
    """
    return F.lower(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    )


def source_type(host: Column) -> Column:
    """Source type by the pipeline's rules on a lower-case host name."""
    return (
        F.when(contains_any(host, PIPELINE_GOVERNMENT), "primary")
        .when(contains_any(host, PIPELINE_FACT_CHECK), "fact_check")
        .when(contains_any(host, PIPELINE_EDUCATION), "primary")
        .when(contains_any(host, PIPELINE_NEWS), "secondary")
        .otherwise("unknown")
    )


def analyzer_source_type(host: Column) -> Column:
    """Source type by the analyzer's rules (everything unmatched is secondary)."""
    host = F.lower(host)
    return (
        F.when(contains_any(host, ANALYZER_GOVERNMENT), "primary")
        .when(contains_any(host, ANALYZER_EDUCATION), "primary")
        .when(contains_any(host, ANALYZER_FACT_CHECK), "fact_check")
        .when(contains_any(host, ANALYZER_ORGANISATIONS), "primary")
        .otherwise("secondary")
    )


def credibility(kind: Column) -> Column:
    """Credibility score of a source type."""
    return (
        F.when(kind == "primary", 0.85)
        .when(kind == "fact_check", 0.8)
        .when(kind == "secondary", 0.7)
        .otherwise(0.5)
    )
