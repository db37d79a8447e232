"""Stored results: nested documents, history, deletion, media summary, dashboard."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.functions.rules import VERDICTS
from credlake.functions.text import history_preview
from credlake.operators.common import paged

# A page of a document holds so many entries of each list.
PAGE_ITEMS = 1000


def result_documents(
    requests: DataFrame,
    claims: DataFrame,
    verdicts: DataFrame,
    evidence: DataFrame,
    sources: DataFrame,
    fact_checks: DataFrame,
    media: DataFrame,
    page_items: int = PAGE_ITEMS,
) -> DataFrame:
    """Nested documents of all requests, in pages of ``page_items`` entries of each list.

    The children are stacked and grouped once by request and page. Every page carries the
    request, its verdict and the media counts of the whole request; page 0 exists for every
    request.
    """
    children = {
        "claims": (claims, "claim_id"),
        "evidence": (evidence, "evidence_id"),
        "source_analysis": (sources, "source_id"),
        "fact_checks": (fact_checks, "fact_check_id"),
        "media": (media, "media_id"),
    }
    rows = requests.select("request_id", F.lit(0).alias("page"))
    for name, (child, item) in children.items():
        columns = [item] + [c for c in child.columns if c not in ("request_id", item)]
        numbered = paged(child, ["request_id"], item, page_items)
        rows = rows.unionByName(numbered.select("request_id", "page", F.struct(*columns).alias(name)), allowMissingColumns=True)
    lists = rows.groupBy("request_id", "page").agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in children])
    verdict = verdicts.select("request_id", "verdict", "confidence", "evidence_strength", "limitations")
    reuse = media.groupBy("request_id").agg(F.count_if("is_reused").alias("__reused"), F.count_if(~F.col("is_reused")).alias("__fresh"))
    header = requests.join(verdict, "request_id", "left").join(reuse, "request_id", "left")
    out = lists.join(header, "request_id")

    def only(relation: str) -> Column:
        return F.filter("evidence", lambda e: e["relation"] == relation)

    return out.select(
        "request_id",
        "page",
        *[c for c in requests.columns if c != "request_id"],
        F.coalesce("verdict", F.lit("unverified")).alias("verdict"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("evidence_strength", F.lit("unknown")).alias("evidence_strength"),
        "claims",
        only("supports").alias("supporting_evidence"),
        only("contradicts").alias("contradicting_evidence"),
        only("neutral").alias("neutral_evidence"),
        F.filter("source_analysis", lambda s: s["source_type"] == "primary").alias("primary_sources"),
        "fact_checks",
        "source_analysis",
        F.struct(
            F.filter("media", lambda m: m["media_type"] == "image").alias("images"),
            F.filter("media", lambda m: m["media_type"] == "video").alias("videos"),
            F.coalesce("__reused", F.lit(0)).alias("reused_media_count"),
            F.coalesce("__fresh", F.lit(0)).alias("unverified_media_count"),
        ).alias("media_analysis"),
        F.when(F.coalesce("limitations", F.lit("")) == "", F.array().cast("array<string>"))
        .otherwise(F.split("limitations", "; "))
        .alias("limitations"),
    )


def stored_result(tables: dict[str, DataFrame], request_id) -> dict[str, DataFrame]:
    """Rows of one request from every table; the filter reaches the files."""
    return {name: df.filter(F.col("request_id") == request_id) for name, df in tables.items()}


def history_page(requests: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of requests, newest first, with shortened text (a top-k read)."""
    return (
        requests.orderBy(F.desc("created_at"), "request_id")
        .offset(skip)
        .limit(limit)
        .withColumn("original_text", history_preview(F.col("original_text")))
    )


def delete_requests(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given requests and their children (new snapshots)."""
    return {name: df.join(ids, "request_id", "left_anti") for name, df in tables.items()}


def media_summary(media: DataFrame) -> DataFrame:
    """Images, videos, reused and not reused items per request."""
    kind, reused = F.col("media_type"), F.col("is_reused")
    return media.groupBy("request_id").agg(
        F.count_if(kind == "image").alias("images"),
        F.count_if(kind == "video").alias("videos"),
        F.count_if(reused).alias("reused_media_count"),
        F.count_if(~reused).alias("unverified_media_count"),
    )


# ---- dashboard --------------------------------------------------------------


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    """One row: all checks and checks per verdict."""
    names = {v: "false_count" if v == "false" else v for v in VERDICTS}
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_checks"),
        *[F.count_if(F.col("verdict") == v).alias(name) for v, name in names.items()],
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def dashboard_averages(verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: mean confidence, sources per check, primary to secondary ratio."""
    counts = sources.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("source_type") == "primary").alias("primary"),
            F.count_if(F.col("source_type") == "secondary").alias("secondary"),
        ).alias("c")
    ).scalar()
    checks = verdicts.agg(
        F.avg("confidence").alias("average_confidence"), F.count(F.lit(1)).alias("n_checks")
    ).withColumn("c", counts)
    return checks.select(
        F.round("average_confidence", 6).alias("average_confidence"),
        F.round(F.try_divide("c.n", "n_checks"), 6).alias("average_sources_per_check"),
        F.round(F.try_divide("c.primary", "c.secondary"), 6).alias("primary_secondary_ratio"),
    )


def batch_totals(df: DataFrame, valid: Column, names: tuple[str, str] = ("n_rows", "n_valid")) -> DataFrame:
    """One row: all rows and those for which ``valid`` holds."""
    return df.agg(F.count(F.lit(1)).alias(names[0]), F.count_if(valid).alias(names[1]))
