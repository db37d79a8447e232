"""Verification of all requests of a batch at once, from stored search results."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.functions import answers
from credlake.functions.text import verification_text
from credlake.operators import evidence as ev
from credlake.operators import pages as pg
from credlake.operators import verdicts as vd
from credlake.operators.common import materialize
from credlake.sources import committed


@dataclass
class Verification:
    """Lazy tables of one run."""

    claims: DataFrame
    sources: DataFrame
    evidence: DataFrame
    fact_checks: DataFrame
    verdicts: DataFrame

    def save(self, root: str, run: str) -> bool:
        """Commit all tables of the run at once; False if the run is stored already."""
        names = ("claims", "sources", "evidence", "fact_checks", "verdicts")
        tables = {name: getattr(self, name) for name in names}
        return committed.commit(self.claims.sparkSession, root, run, tables)


def verify(
    requests: DataFrame, claims: DataFrame, results: DataFrame, headlines: DataFrame | None = None
) -> Verification:
    """Requests, their claims and search results to sources, evidence and verdicts.

    ``headlines`` holds the headline flags per request; missing flags are false. The
    merged candidates feed sources, evidence and counts, so they are written once
    instead of being shuffled together for each.
    """
    merged = ev.merge_search_results(results, claims)
    candidates = materialize(ev.claim_results(claims, merged), "candidates")
    sources = ev.unique_sources(ev.source_rows(candidates))
    evidence = ev.evidence_rows(candidates)
    checks = ev.pipeline_fact_checks(claims, results)
    base = requests.select("request_id").distinct()
    if headlines is not None:
        base = base.join(
            headlines.select("request_id", "exaggeration_detected", "headline_body_contradiction"),
            "request_id",
            "left",
        )
    counts = vd.with_headline_flags(vd.request_counts(base, evidence, sources))
    checks = checks.withColumn(
        "fact_check_id",
        F.md5(F.concat_ws("|", F.col("claim_id").cast("string"), F.col("position").cast("string"))),
    )
    return Verification(claims, sources, evidence, checks, vd.verdict_rows(counts))


def claims_from_answers(requests: DataFrame) -> DataFrame:
    """Claims of requests from stored model answers (request_id, text, answer,
    category_answer): one row per claim, a fallback claim where there is none."""
    from credlake.functions.rules import category

    listed = requests.select(
        "request_id",
        category(F.col("category_answer")).alias("category"),
        F.posexplode(answers.claim_list(F.col("answer"), F.col("text"))).alias("position", "c"),
    )
    return listed.select(
        F.md5(F.concat_ws("|", F.col("request_id").cast("string"), F.col("position").cast("string"))).alias(
            "claim_id"
        ),
        "request_id",
        "position",
        F.coalesce("c.text", F.lit("")).alias("text"),
        *[F.col(f"c.{n}").alias(n) for n in answers.CLAIM_FIELDS if n != "text"],
        "category",
    )


def verify_pages(pages: DataFrame, results: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Raw pages to one verdict row per page: extraction, one claim per page, verdict.

    ``pages`` carries request_id, url, html and optionally error and message;
    ``results`` carries request_id and search result columns.
    """
    for name in ("error", "message"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast("string"))
    articles = materialize(pg.article_rows(pages, max_chars), "articles")
    claims = articles.filter(F.col("text") != "").select(
        F.col("request_id").alias("claim_id"),
        "request_id",
        verification_text(F.col("title"), F.col("text")).alias("text"),
    )
    found = results.withColumn("claim_id", F.col("request_id")).drop("request_id")
    run = verify(articles.select("request_id"), claims, found)
    outcome = run.verdicts.select(
        "request_id", "verdict", "confidence", "evidence_strength", "limitations",
        "supporting_evidence_count", "contradicting_evidence_count",
    )
    return vd.with_failures(articles.join(outcome, "request_id", "left"))
