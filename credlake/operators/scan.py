"""Registry scans: article lists, trending and daily reports, scan verdicts.

Registry rows carry list_kind, seq, name, source_url, country, category, language,
credibility; result rows carry source_url, rank, url, title, snippet, published_date.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credlake.functions import rules
from credlake.operators.common import first_by

# Defaults of incomplete registry rows.
REGISTRY_DEFAULTS = {
    "country": "Unknown", "category": "news", "language": "en", "credibility": "medium",
}


def registry_articles(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Article rows: results joined with the attributes of their registry source."""
    filled = registry.withColumns(
        {n: F.coalesce(F.col(n), F.lit(v)) for n, v in REGISTRY_DEFAULTS.items()}
    ).select(
        "list_kind",
        "seq",
        F.col("name").alias("source_name"),
        "source_url",
        F.col("country").alias("source_country"),
        "category",
        "language",
        "credibility",
    )
    return results.join(filled, "source_url")


def _results_per_source(results: DataFrame, n: int) -> DataFrame:
    """First n results of each source; the bound is applied before the shuffle."""
    order = Window.partitionBy("source_url").orderBy("rank")
    return results.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def _first_urls(articles: DataFrame, limit: int) -> DataFrame:
    """Each URL once, in source and result order, the first ``limit`` of them. The
    input is bounded by sources x results, both fixed by the report."""
    unique = first_by(
        articles.filter(F.coalesce(F.col("url"), F.lit("")) != ""), ["url"], ["source_no", "position"]
    )
    return unique.orderBy("source_no", "position").limit(limit)


def trending(registry: DataFrame, results: DataFrame, limit: int = 20, n_sources: int = 15) -> DataFrame:
    """Trending report: two results of each of the first 15 news sources."""
    top = registry.filter(F.col("list_kind") == "news").orderBy("seq", "source_url").limit(n_sources)
    return _report(top, ["seq", "source_url"], results, 2, limit, n_sources)


def daily_updates(registry: DataFrame, results: DataFrame, limit: int = 20, n_sources: int = 20) -> DataFrame:
    """Daily report: one result of each of the first 20 sources, news before articles."""
    kind = F.when(F.col("list_kind") == "news", 0).otherwise(1)
    top = registry.withColumn("__kind", kind).orderBy("__kind", "seq", "source_url").limit(n_sources)
    return _report(top, ["__kind", "seq", "source_url"], results, 1, limit, n_sources)


def _report(
    sources: DataFrame, order: list[str], results: DataFrame, per_source: int, limit: int, n_sources: int
) -> DataFrame:
    # at most n_sources rows, so one task numbers them
    numbered = sources.withColumn("source_no", F.row_number().over(Window.orderBy(*order)))
    chosen = results.join(
        numbered.select("source_url", "source_no"), "source_url"
    )
    picked = _results_per_source(chosen, per_source)
    articles = registry_articles(numbered, picked)
    return _first_urls(articles, limit).select(
        "source_no", "position", "title", "url", "snippet", "source_name", "source_url",
        "source_country", "language", "credibility", "published_date",
    )


def category_scan(registry: DataFrame, results: DataFrame, per_list: int = 10, per_source: int = 3) -> DataFrame:
    """Scan the first sources of each list: one row per source with its articles
    (at most ``per_source``, so the list is bounded); sources without results drop out."""
    order = Window.partitionBy("list_kind").orderBy("seq", "source_url")
    top = registry.withColumn("source_no", F.row_number().over(order)).filter(
        F.col("source_no") <= per_list
    )
    chosen = results.join(top.select("source_url"), "source_url", "left_semi")
    articles = registry_articles(top, _results_per_source(chosen, per_source))
    article = F.struct(
        "position", "url", "title", "snippet", "source_country", "category", "language", "credibility"
    )
    return articles.groupBy("list_kind", "source_url", "source_name").agg(
        F.sort_array(F.collect_list(article)).alias("articles")
    )


def scan_counts(article_results: DataFrame, by: str = "article_id") -> DataFrame:
    """Results, supporting and contradicting titles and claims checked per article.

    Counted over result sets, so a URL found by two queries counts twice.
    """
    rel = rules.scan_relation(F.lower(F.coalesce("title", F.lit(""))))
    return (
        article_results.withColumn("__rel", rel)
        .groupBy(by)
        .agg(
            F.count("rank").alias("evidence_count"),
            F.count_if(F.col("__rel") == "supports").alias("supporting"),
            F.count_if(F.col("__rel") == "contradicts").alias("contradicting"),
            F.count_distinct("claim_id").alias("claims_checked"),
        )
    )


def scan_verdicts(articles: DataFrame, counts: DataFrame, by: str = "article_id") -> DataFrame:
    """Scan verdict per article; articles without title and snippet stay unverified."""
    names = ["evidence_count", "supporting", "contradicting", "claims_checked"]
    joined = articles.join(counts, by, "left").na.fill(0, names)
    empty = (F.coalesce("title", F.lit("")) == "") & (F.coalesce("snippet", F.lit("")) == "")
    n = F.col("evidence_count")
    score = rules.scan_score(F.col("supporting"), F.col("contradicting"))
    return joined.withColumn("score", score).withColumns(
        {
            "verdict": F.when(empty, "unverified").otherwise(rules.scan_verdict(F.col("score"), n)),
            "confidence": F.when(empty, 0.0).otherwise(rules.scan_confidence(n)),
            "reason": F.when(empty, "No content to verify"),
        }
    )
