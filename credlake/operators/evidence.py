"""Search results to sources, evidence and fact checks, and their aggregates.

Input rows carry request_id, claim_id, query_no, rank, url, title, snippet,
published_date. All requests are processed together, keyed by request_id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlake.functions import rules, urls
from credlake.operators.common import first_by, first_rows, paged

RESULT_ORDER = ["claim_id", "query_no", "rank"]


def _not_blank_url() -> Column:
    return F.coalesce(F.col("url"), F.lit("")) != ""


def merge_search_results(
    results: DataFrame, claims: DataFrame, per_query: int = 5, max_queries: int = 7
) -> DataFrame:
    """Per claim: results of its ordered queries with each URL once (the first), at
    most per_query x number of queries.

    The constant bound lets Spark cut every claim to that many rows before the
    shuffle; the exact bound of the claim follows.
    """
    unique = first_rows(results.filter(_not_blank_url()), ["claim_id", "url"], RESULT_ORDER)
    order = Window.partitionBy("claim_id").orderBy("query_no", "rank")
    ranked = unique.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= per_query * max_queries
    )
    caps = claims.select(
        "claim_id", (F.size(rules.search_queries(F.col("text"))) * per_query).alias("__cap")
    )
    return ranked.join(caps, "claim_id").filter(F.col("position") <= F.col("__cap")).drop("__cap")


def claim_results(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims with their search results: the candidates for evidence."""
    return claims.select("claim_id", "request_id", F.col("text").alias("claim_text")).join(
        results, "claim_id"
    )


def source_id(request: Column, url: Column) -> Column:
    return F.md5(F.concat_ws("|", request.cast("string"), url))


def source_rows(candidates: DataFrame) -> DataFrame:
    """A source row per result that has a URL."""
    host = urls.domain(F.col("url"))
    return (
        candidates.filter(_not_blank_url())
        .withColumn("domain", host)
        .withColumn("source_type", urls.source_type(F.col("domain")))
        .select(
            source_id(F.col("request_id"), F.col("url")).alias("source_id"),
            "request_id",
            "url",
            F.coalesce("title", F.lit("")).alias("title"),
            "domain",
            "source_type",
            F.col("domain").alias("publisher"),
            F.lit(None).cast("string").alias("author"),
            F.col("published_date").alias("publication_date"),
            urls.credibility(F.col("source_type")).alias("credibility_score"),
            F.lit(True).alias("is_independent"),
            *RESULT_ORDER,
        )
    )


def unique_sources(sources: DataFrame) -> DataFrame:
    """Each URL of a request once, the first result winning; blank URLs dropped."""
    return first_rows(sources.filter(_not_blank_url()), ["request_id", "url"], ["request_id", *RESULT_ORDER])


def evidence_rows(candidates: DataFrame) -> DataFrame:
    """An evidence row per result whose snippet has at least 20 characters."""
    title = F.lower(F.coalesce("title", F.lit("")))
    return (
        candidates.filter(F.length("snippet") >= 20)
        .withColumn("relation", rules.relation(title))
        .select(
            F.md5(F.concat_ws("|", F.col("claim_id").cast("string"), F.col("url"))).alias("evidence_id"),
            "request_id",
            "claim_id",
            source_id(F.col("request_id"), F.col("url")).alias("source_id"),
            "url",
            "title",
            F.substring("snippet", 1, 500).alias("text"),
            "relation",
            rules.relation_confidence(F.col("relation")).alias("confidence"),
            F.lit("search_snippet").alias("extraction_method"),
        )
    )


# ---- fact checks ------------------------------------------------------------


def _with_claims(hits: DataFrame, claims: DataFrame, per_claim: int) -> DataFrame:
    """The first hits of each claim in result order, with their claim. The limit comes
    before the join, so a claim with very many results is small by then."""
    order = Window.partitionBy("claim_id").orderBy("query_no", "rank")
    first = hits.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= per_claim
    )
    return claim_results(claims, first)


def pipeline_fact_checks(claims: DataFrame, results: DataFrame, per_claim: int = 3) -> DataFrame:
    """Fact-check hits by title, at most three per claim in result order."""
    title = F.coalesce("title", F.lit(""))
    hits = results.filter(rules.is_pipeline_fact_check(F.lower(title)))
    return _with_claims(hits, claims, per_claim).select(
        "request_id",
        "claim_id",
        "position",
        rules.first_word(F.col("title")).alias("organization"),
        F.substring("claim_text", 1, 200).alias("claim_checked"),
        F.lit(rules.NO_CONCLUSION).alias("conclusion"),
        F.substring("snippet", 1, 300).alias("summary"),
        F.col("published_date").alias("date"),
        "url",
    )


def service_fact_checks(claims: DataFrame, results: DataFrame, per_claim: int = 5) -> DataFrame:
    """Fact-check hits by URL or title: each URL once per claim, at most five."""
    title = F.coalesce("title", F.lit(""))
    url = F.lower("url")
    hits = results.filter(_not_blank_url() & rules.is_fact_check_source(url, F.lower(title)))
    unique = first_by(hits, ["claim_id", "url"], RESULT_ORDER)
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce("snippet", F.lit(""))))
    return _with_claims(unique, claims, per_claim).select(
        "request_id",
        "claim_id",
        "position",
        rules.organisation(url).alias("organization"),
        F.substring("claim_text", 1, 300).alias("claim_checked"),
        rules.conclusion(text).alias("conclusion"),
        F.substring("snippet", 1, 500).alias("summary"),
        F.col("published_date").alias("date"),
        "url",
        "title",
    )


# ---- joins and aggregates ---------------------------------------------------


def evidence_with_source(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with its source as a struct, null when the source is unknown."""
    source = sources.select(
        "source_id",
        F.struct(
            "source_id", "url", "title", "domain", "source_type", "publisher", "author",
            "publication_date", "credibility_score", "is_independent",
        ).alias("source"),
    )
    return evidence.join(source, "source_id", "left")


def cited_sources(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sources that at least one piece of evidence refers to."""
    return sources.join(evidence.select("source_id"), "source_id", "left_semi")


def evidence_counts(evidence: DataFrame, by: str = "request_id") -> DataFrame:
    """Supporting, contradicting and neutral counts (partial relations in none)."""
    rel = F.col("relation")
    return evidence.groupBy(by).agg(
        F.count_if(rel == "supports").alias("supporting"),
        F.count_if(rel == "contradicts").alias("contradicting"),
        F.count_if(rel == "neutral").alias("neutral"),
    )


def source_counts(sources: DataFrame, by: str = "request_id") -> DataFrame:
    """Unique and primary sources per request, from de-duplicated source rows."""
    return sources.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.count_if(F.col("source_type") == "primary").alias("n_primary"),
    )


def source_relation_counts(evidence: DataFrame) -> DataFrame:
    """Supporting and contradicting evidence per source."""
    return evidence_counts(evidence, "source_id").select(
        "source_id",
        F.col("supporting").alias("supporting_evidence_count"),
        F.col("contradicting").alias("contradicting_evidence_count"),
    )


def scored_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Each piece of evidence with its score."""
    facts = sources.select("source_id", "source_type", "is_independent", "credibility_score")
    joined = evidence.join(facts.withColumn("__has", F.lit(True)), "source_id", "left")
    return joined.withColumn(
        "score",
        rules.evidence_score(
            F.col("relation"),
            F.col("source_type"),
            F.col("is_independent"),
            F.col("credibility_score"),
            F.coalesce("__has", F.lit(False)),
        ),
    ).drop("__has")


def group_scores(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """Confidence-weighted score per request, 0 to 100; 0 without evidence."""
    sums = scored.groupBy("request_id").agg(F.sum(F.col("score") * F.col("confidence")).alias("__sum"))
    total = F.coalesce("__sum", F.lit(0.0))
    return requests.join(sums, "request_id", "left").select(
        "request_id", F.round(rules.clamp(total, 0.0, 100.0), 6).alias("group_score")
    )


def domain_groups(sources: DataFrame) -> DataFrame:
    """Sources per domain and request; domains with several sources are dependent."""
    return (
        sources.groupBy("request_id", F.coalesce("domain", F.lit("")).alias("domain"))
        .agg(F.count(F.lit(1)).alias("n_sources"))
        .withColumn("independent", F.col("n_sources") == 1)
    )


def source_independence(sources: DataFrame) -> DataFrame:
    """Per request: sources, independent sources, dependent domains, ratio."""
    return domain_groups(sources).groupBy("request_id").agg(
        F.sum("n_sources").alias("total_sources"),
        F.count_if(F.col("independent")).alias("independent_sources"),
        F.count_if(~F.col("independent")).alias("dependent_groups"),
        F.round(F.count_if(F.col("independent")) / F.sum("n_sources"), 6).alias(
            "true_independence_ratio"
        ),
    )


def dependent_source_groups(sources: DataFrame, page_urls: int = 1000) -> DataFrame:
    """Dependent domains with count and URL list, in pages of ``page_urls`` URLs in order."""
    keyed = sources.select("request_id", F.coalesce("domain", F.lit("")).alias("domain"), "url")
    dependent = domain_groups(sources).filter(~F.col("independent")).drop("independent")
    pages = paged(keyed, ["request_id", "domain"], "url", page_urls)
    lists = pages.groupBy("request_id", "domain", "page").agg(F.sort_array(F.collect_list("url")).alias("urls"))
    return lists.join(dependent, ["request_id", "domain"]).select("request_id", "domain", "page", "n_sources", "urls")


# ---- source analysis --------------------------------------------------------


def analyze_sources(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Factors, strengths and warnings of every source, with its evidence counts.

    One aggregate over the evidence and one join replace a look-up per source.
    """
    joined = sources.join(source_relation_counts(evidence), "source_id", "left").na.fill(
        0, ["supporting_evidence_count", "contradicting_evidence_count"]
    )
    kind, score = F.col("source_type"), F.col("credibility_score")
    mixed = (F.col("supporting_evidence_count") > 0) & (F.col("contradicting_evidence_count") > 0)
    # The texts of the analysis.
    return joined.withColumns(
        {
            "factors": rules.compact(
                F.when(kind == "primary", "High trust weight")
                .when(kind == "fact_check", "Specialized verification")
                .when(kind == "secondary", "Established news organization")
            ),
            "strengths": rules.compact(
                F.when(kind == "primary", "Primary source - direct from original publisher").when(
                    kind == "fact_check", "Reputable fact-checking organization"
                ),
                F.when(F.col("is_independent"), "Independent source"),
                F.when(score >= 0.8, "High credibility score"),
            ),
            "warnings": rules.compact(
                F.when(score <= 0.4, "Low credibility score"),
                F.when(mixed, "Source provides both supporting and contradicting evidence"),
            ),
        }
    )


def evidence_texts(evidence: DataFrame, per_relation: int = 5) -> DataFrame:
    """The first five evidence texts per request and relation (a display list)."""
    order = Window.partitionBy("request_id", "relation").orderBy("claim_id", "evidence_id")
    return evidence.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= per_relation
    )
