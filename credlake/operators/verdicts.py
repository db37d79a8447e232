"""Rule-based verdicts per request, failure rows, timeline."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.functions import rules
from credlake.operators.evidence import evidence_counts, source_counts


def request_counts(requests: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests with evidence and source counts, zero where there are none.

    Both sides aggregate to one row per request before they are joined.
    """
    counts = ["supporting", "contradicting", "neutral", "n_sources", "n_primary"]
    return (
        requests.join(evidence_counts(evidence), "request_id", "left")
        .join(source_counts(sources), "request_id", "left")
        .na.fill(0, counts)
    )


def with_headline_flags(counts: DataFrame) -> DataFrame:
    """Make sure the two headline flags exist and are not null."""
    flags = {}
    for name in ("exaggeration_detected", "headline_body_contradiction"):
        flags[name] = (
            F.coalesce(F.col(name), F.lit(False)) if name in counts.columns else F.lit(False)
        )
    return counts.withColumns(flags)


def verdict_rows(counts: DataFrame) -> DataFrame:
    """The full verdict row of every request from its counts and headline flags."""
    s, c, n = F.col("supporting"), F.col("contradicting"), F.col("neutral")
    p, t = F.col("n_primary"), F.col("n_sources")
    exaggerated, contradicted = F.col("exaggeration_detected"), F.col("headline_body_contradiction")
    scored = with_headline_flags(counts).withColumn(
        "score", rules.verdict_score(s, c, n, p, exaggerated, contradicted)
    )
    limits = rules.limitations(t, p, exaggerated)
    return scored.withColumns(
        {
            "verdict": rules.verdict(F.col("score"), s, c),
            "evidence_strength": rules.evidence_strength(F.col("score"), s, c),
            "confidence": rules.verdict_confidence(s, c),
            "limitations": F.array_join(limits, "; "),
            "evidence_summary": rules.evidence_summary(t, p, s, c, n),
            "factors": rules.verdict_factors(p, c, s, exaggerated),
            "supporting_evidence_count": s,
            "contradicting_evidence_count": c,
            "neutral_evidence_count": n,
        }
    )


def limitation_list(joined: F.Column) -> F.Column:
    """Stored limitations back to a list; none for an empty string."""
    return F.when(F.coalesce(joined, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(joined, "; ")
    )


def engine_assessment(counts: DataFrame) -> DataFrame:
    """Confidence and strength by the scoring engine's rules."""
    s, c, n = F.col("supporting"), F.col("contradicting"), F.col("neutral")
    return counts.withColumns(
        {
            "engine_confidence": rules.engine_confidence(s, c, n, F.col("n_sources")),
            "engine_strength": rules.engine_strength(s, c, F.col("n_primary")),
        }
    )


def request_status(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Status of each request: completed once a verdict exists, a failure stays one."""
    done = verdicts.select("request_id").distinct().withColumn("__done", F.lit(True))
    status = (
        F.when(F.col("status") == "failed", "failed")
        .when(F.col("__done"), "completed")
        .otherwise("processing")
    )
    return requests.join(done, "request_id", "left").withColumn("status", status).drop("__done")


def with_failures(pages: DataFrame) -> DataFrame:
    """Status and error of page rows: an extraction error or empty text fails; failed
    rows get the fixed verdict ``unverified`` with confidence 0."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    status = F.when(failed | empty, "failed").otherwise("completed")
    message = F.when(failed, F.coalesce("message", F.lit("Extraction failed"))).when(
        empty, "No content extracted"
    )
    bad = F.col("status") == "failed"
    out = pages.withColumns({"status": status, "failure": message})
    defaults = {"verdict": F.lit("unverified"), "confidence": F.lit(0.0), "evidence_strength": F.lit("unknown")}
    return out.withColumns(
        {
            name: F.when(bad, value).otherwise(
                F.coalesce(F.col(name), value) if name in pages.columns else value
            )
            for name, value in defaults.items()
        }
    )


def timeline(docs: DataFrame, default_year: int = 2024) -> DataFrame:
    """Timeline rows per request: source year, verification year, and a warning row
    when the headline exaggerates. ``verified_year`` is a column of the input."""
    # Labels of the timeline.
    def event(year, label: str, kind: str):
        return F.struct(year.cast("int").alias("year"), F.lit(label).alias("label"), F.lit(kind).alias("type"))

    source_year = F.coalesce(F.year(F.expr("try_to_timestamp(event_date)")), F.lit(default_year))
    events = rules.compact(
        event(source_year, "Original Event / Source Publication", "source"),
        event(F.col("verified_year"), "Current Verification", "verification"),
        F.when(
            F.col("exaggeration_detected"),
            event(F.col("verified_year"), "Headline Exaggeration Detected", "warning"),
        ),
    )
    return docs.select("request_id", F.inline(events))
