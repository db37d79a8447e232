"""Evidence, fact-check and verdict rules as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credlake.functions.text import contains_any, split_words

# Title words of the evidence relation (substring tests).
CONTRADICT_WORDS = ["deny", "denies", "false", "fake", "myth", "not true", "incorrect"]
SUPPORT_WORDS = ["confirm", "confirms", "true", "real", "official", "announcement"]
# Title words of the scan relation.
SCAN_CONTRADICT_WORDS = ["false", "fake", "myth", "deny"]
SCAN_SUPPORT_WORDS = ["true", "confirm", "real"]
# Fact-check sources.
PIPELINE_FACT_CHECK_TITLES = ["fact check", "politifact", "snopes", "factcheck"]
FACT_CHECK_URLS = [
    "factcheck.org", "politifact.com", "snopes.com", "reuters.com/fact-check",
    "ap.org/fact-check", "bbc.com/reality_check", "npr.org/sections/factcheck",
]
FACT_CHECK_TITLES = ["fact check", "fact-check", "verification", "true or false", "myth", "debunk"]
# Organisation by URL substring, in test order.
ORGANISATIONS = [
    (["politifact"], "PolitiFact"),
    (["snopes"], "Snopes"),
    (["factcheck.org"], "FactCheck.org"),
    (["reuters"], "Reuters Fact Check"),
    (["ap.org", "apnews"], "Associated Press"),
    (["bbc"], "BBC Reality Check"),
    (["npr"], "NPR Fact Check"),
]
# Conclusion words, in test order.
TRUE_WORDS = ["true", "accurate", "correct", "confirmed"]
FALSE_WORDS = ["false", "incorrect", "wrong", "debunked", "myth"]
HEDGES = ["partially", "mostly"]
MISLEADING_WORDS = ["misleading", "out of context", "lacks context"]
UNPROVEN_WORDS = ["unproven", "unverified", "no evidence"]
NO_CONCLUSION = "See source for details"
# Claim categories, in test order.
CATEGORIES = [
    "Politics", "Science", "Health", "Technology", "Business", "Sports", "Entertainment",
    "Environment", "Education", "Crime", "International Affairs", "Local News", "Other",
]
# Score floors with verdict and evidence strength.
VERDICT_BUCKETS = [
    (80, "verified", "HIGH"),
    (65, "likely_true", "MEDIUM-HIGH"),
    (50, "partially_true", "MEDIUM"),
    (35, "misleading", "MEDIUM-LOW"),
    (20, "unverified", "LOW"),
    (10, "likely_false", "LOW"),
]
LOWEST_VERDICT = ("false", "VERY LOW")
VERDICTS = [name for _, name, _ in VERDICT_BUCKETS] + [LOWEST_VERDICT[0]]
# Limitation texts.
FEW_SOURCES = "Limited number of sources analyzed"
NO_PRIMARY = "No primary sources found"
EXAGGERATED = "Headline exaggeration detected"


def clamp(col: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def compact(*items: Column) -> Column:
    """Array of the items that are not null, in order."""
    return F.array_compact(F.array(*items))


# ---- search queries ---------------------------------------------------------


def search_queries(claim: Column) -> Column:
    """Ordered web queries of a claim (at most seven)."""
    words = split_words(claim)
    long_claim = F.size(words) > 5
    return compact(
        claim,
        F.when(long_claim, F.array_join(F.slice(words, 1, 5), " ")),
        F.when(long_claim, F.array_join(F.slice(words, -5, 5), " ")),
        F.concat(claim, F.lit(" official")),
        F.concat(claim, F.lit(" fact check")),
        F.concat(claim, F.lit(" government")),
    )


def _suffixed(claim: Column, suffixes: list[str]) -> Column:
    return F.array(*[F.concat(claim, F.lit(s)) for s in suffixes])


def fact_check_queries(claim: Column) -> Column:
    """The two fact-check queries the pipeline sends."""
    return _suffixed(claim, [" fact check", " politifact"])


def fact_check_service_queries(claim: Column) -> Column:
    """The four queries of the fact-check service."""
    return _suffixed(claim, [" fact check", " politifact", " snopes", " factcheck.org"])


def scan_queries(claim: Column) -> Column:
    """The two queries of an article scan."""
    return _suffixed(claim, ["", " fact check"])


def site_query(source_url: Column, purpose: str = "scan") -> Column:
    """Query that lists a registry source's latest items."""
    ending = {
        "scan": " latest news",
        "trending": " latest news today",
        "daily": " new update today",
    }[purpose]
    return F.concat(F.lit("site:"), source_url, F.lit(ending))


# ---- evidence ---------------------------------------------------------------


def relation(title_lower: Column) -> Column:
    """Evidence relation by title words; contradiction is tested first."""
    return (
        F.when(contains_any(title_lower, CONTRADICT_WORDS), "contradicts")
        .when(contains_any(title_lower, SUPPORT_WORDS), "supports")
        .otherwise("neutral")
    )


def relation_confidence(rel: Column) -> Column:
    return F.when(rel == "neutral", 0.5).otherwise(0.6)


def scan_relation(title_lower: Column) -> Column:
    """Relation used by scans; titles without a keyword count only in the total."""
    return F.when(contains_any(title_lower, SCAN_CONTRADICT_WORDS), "contradicts").when(
        contains_any(title_lower, SCAN_SUPPORT_WORDS), "supports"
    )


def evidence_score(
    rel: Column, source_type: Column, independent: Column, credibility: Column, has_source: Column
) -> Column:
    """Score of one piece of evidence, 0 to 100; source terms need a source."""
    by_type = (
        F.when(source_type == "primary", 30)
        .when(source_type == "secondary", 10)
        .when(source_type == "fact_check", 15)
        .otherwise(0)
    )
    by_credibility = F.when(credibility > 0.8, 10).when(credibility < 0.4, -10).otherwise(0)
    by_source = by_type + F.when(independent, 20).otherwise(0) + by_credibility
    by_relation = (
        F.when(rel == "contradicts", -30)
        .when(rel == "supports", 10)
        .when(rel == "partially_contradicts", -15)
        .otherwise(0)
    )
    total = F.lit(50.0) + F.when(has_source, by_source).otherwise(0) + by_relation
    return clamp(total, 0.0, 100.0)


# ---- verdicts ---------------------------------------------------------------


def verdict_score(
    supporting: Column,
    contradicting: Column,
    neutral: Column,
    primary: Column,
    exaggerated: Column,
    contradicted: Column,
) -> Column:
    """Pipeline score 0 to 100 from evidence counts and headline flags."""
    raw = (
        F.lit(50)
        + supporting * 5
        + primary * 10
        - contradicting * 8
        - neutral * 2
        - F.when(exaggerated, 10).otherwise(0)
        - F.when(contradicted, 15).otherwise(0)
    )
    return clamp(raw, 0, 100).cast("int")


def _bucket(score: Column, position: int) -> Column:
    out = None
    for row in VERDICT_BUCKETS:
        out = F.when(score >= row[0], row[position]) if out is None else out.when(score >= row[0], row[position])
    return out.otherwise(LOWEST_VERDICT[position - 1])


def verdict_bucket(score: Column) -> Column:
    return _bucket(score, 1)


def strength_bucket(score: Column) -> Column:
    return _bucket(score, 2)


def verdict(score: Column, supporting: Column, contradicting: Column) -> Column:
    return F.when((supporting == 0) & (contradicting == 0), "unverified").otherwise(verdict_bucket(score))


def evidence_strength(score: Column, supporting: Column, contradicting: Column) -> Column:
    return F.when((supporting == 0) & (contradicting == 0), "UNKNOWN").otherwise(strength_bucket(score))


def verdict_confidence(supporting: Column, contradicting: Column) -> Column:
    total = supporting + contradicting
    return F.when(total == 0, 0.3).otherwise(F.least(F.lit(0.99), F.lit(0.5) + total * 0.05))


def limitations(n_sources: Column, primary: Column, exaggerated: Column) -> Column:
    return compact(
        F.when(n_sources < 3, FEW_SOURCES),
        F.when(primary == 0, NO_PRIMARY),
        F.when(exaggerated, EXAGGERATED),
    )


def evidence_summary(
    n_sources: Column, primary: Column, supporting: Column, contradicting: Column, neutral: Column
) -> Column:
    return F.format_string(
        "Analyzed %d sources including %d primary sources. Found %d supporting, "
        "%d contradicting, and %d neutral evidence items.",
        n_sources, primary, supporting, contradicting, neutral,
    )


def verdict_factors(
    primary: Column, contradicting: Column, supporting: Column, exaggerated: Column
) -> Column:
    return compact(
        F.when(primary > 0, F.format_string("%d primary source(s) analyzed", primary)),
        F.when(contradicting > 0, F.format_string("%d contradicting evidence item(s)", contradicting)),
        F.when(supporting > 0, F.format_string("%d supporting evidence item(s)", supporting)),
        F.when(exaggerated, "headline exaggeration detected"),
    )


def engine_confidence(
    supporting: Column, contradicting: Column, neutral: Column, n_sources: Column
) -> Column:
    """Confidence of the scoring engine, 0.1 to 0.99; 0.3 without sources or evidence."""
    total = supporting + contradicting + neutral
    conflict = F.when(
        (supporting > 0) & (contradicting > 0),
        F.least(F.lit(0.15), F.abs(supporting - contradicting) * 0.01),
    ).otherwise(0.0)
    value = (
        (F.lit(0.5) - conflict)
        + F.least(F.lit(0.3), total * 0.03)
        + F.least(F.lit(0.2), n_sources * 0.02)
    )
    return F.when((n_sources == 0) | (total == 0), 0.3).otherwise(clamp(value, 0.1, 0.99))


def engine_strength(supporting: Column, contradicting: Column, primary: Column) -> Column:
    return (
        F.when((primary >= 2) & (supporting >= 3) & (contradicting == 0), "HIGH")
        .when((primary >= 1) & (supporting >= 2), "MEDIUM-HIGH")
        .when(supporting >= 2, "MEDIUM")
        .when(supporting >= 1, "LOW")
        .otherwise("VERY LOW")
    )


def scan_score(supporting: Column, contradicting: Column) -> Column:
    return clamp(F.lit(50) + supporting * 5 - contradicting * 8, 0, 100).cast("int")


def scan_verdict(score: Column, n_results: Column) -> Column:
    return F.when(n_results == 0, "unverified").otherwise(verdict_bucket(score))


def scan_confidence(n_results: Column) -> Column:
    return F.least(F.lit(0.95), F.lit(0.3) + n_results * 0.05)


# ---- fact checks ------------------------------------------------------------


def is_pipeline_fact_check(title_lower: Column) -> Column:
    return contains_any(title_lower, PIPELINE_FACT_CHECK_TITLES)


def first_word(title: Column) -> Column:
    """First word of a title, 'Unknown' when the title is empty."""
    return F.when(F.coalesce(title, F.lit("")) == "", "Unknown").otherwise(F.get(split_words(title), 0))


def is_fact_check_source(url_lower: Column, title_lower: Column) -> Column:
    return contains_any(url_lower, FACT_CHECK_URLS) | contains_any(title_lower, FACT_CHECK_TITLES)


def organisation(url_lower: Column) -> Column:
    out = None
    for words, name in ORGANISATIONS:
        test = contains_any(url_lower, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("Unknown Fact-Checking Organization")


def conclusion(text_lower: Column) -> Column:
    """Conclusion read from a text; the word groups are tested in order."""
    hedged = contains_any(text_lower, HEDGES)
    return (
        F.when(contains_any(text_lower, TRUE_WORDS), F.when(hedged, "Mostly True").otherwise("True"))
        .when(contains_any(text_lower, FALSE_WORDS), F.when(hedged, "Mostly False").otherwise("False"))
        .when(contains_any(text_lower, MISLEADING_WORDS), "Misleading")
        .when(contains_any(text_lower, UNPROVEN_WORDS), "Unverified")
        .otherwise(NO_CONCLUSION)
    )


def category(answer: Column) -> Column:
    """First category named in a stored model answer, else Other."""
    lower = F.lower(answer)
    out = None
    for name in CATEGORIES:
        test = lower.contains(name.lower())
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("Other")
