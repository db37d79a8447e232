"""Every branch and boundary of the evidence and verdict rules."""
from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F

from credlake.functions import rules, urls
from credlake.operators import evidence as ev
from credlake.operators import scan as sc
from credlake.operators import verdicts as vd
from credlake.plans import verification as vp


def column(spark, values_in, kind, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values_in)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_verdict_buckets(spark):
    scores = [100, 80, 79, 65, 64, 50, 49, 35, 34, 20, 19, 10, 9, 0]
    names = column(spark, scores, "int", rules.verdict_bucket)
    assert names == [
        "verified", "verified", "likely_true", "likely_true", "partially_true", "partially_true", "misleading",
        "misleading", "unverified", "unverified", "likely_false", "likely_false", "false", "false",
    ]
    strengths = column(spark, [80, 65, 50, 35, 20, 10, 9], "int", rules.strength_bucket)
    assert strengths == ["HIGH", "MEDIUM-HIGH", "MEDIUM", "MEDIUM-LOW", "LOW", "LOW", "VERY LOW"]


def test_title_relation_order_and_substrings(spark):
    titles = ["not true", "really big", "it is incorrect", "official denies", "announcement", "nothing", "fakery"]
    assert column(spark, titles, "string", rules.relation) == [
        "contradicts", "supports", "contradicts", "contradicts", "supports", "neutral", "contradicts",
    ]


def test_conclusions(spark):
    texts = ["mostly accurate", "incorrect", "wrong", "partially debunked", "lacks context", "unproven", "hello"]
    assert column(spark, texts, "string", rules.conclusion) == [
        "Mostly True", "True", "False", "Mostly False", "Misleading", "Unverified", "See source for details",
    ]


@pytest.mark.parametrize(
    "url, domain, kind, analyzer",
    [
        ("https://gov.example.com/page", "gov.example.com", "unknown", "primary"),
        ("https://politifact.com/fact-check", "politifact.com", "fact_check", "fact_check"),
        ("http://u:p@News.Site.org:8080/x|y z", "u:p@news.site.org:8080", "secondary", "secondary"),
        ("https://www.who.int/a", "www.who.int", "unknown", "primary"),
        ("no url", "", "unknown", "secondary"),
        ("//reuters.com?x", "reuters.com", "fact_check", "fact_check"),
        ("https://bbc.com", "bbc.com", "secondary", "fact_check"),
    ],
)
def test_domains_and_types(spark, url, domain, kind, analyzer):
    row = spark.createDataFrame([(url,)], "u string").select(
        urls.domain(F.col("u")).alias("d"),
        urls.source_type(urls.domain(F.col("u"))).alias("k"),
        urls.analyzer_source_type(urls.domain(F.col("u"))).alias("a"),
    ).first()
    assert tuple(row) == (domain, kind, analyzer)


def test_single_evidence_scores(spark):
    rows = [
        ("supports", "primary", True, 0.9, True, 100.0),
        ("contradicts", "secondary", True, 0.5, True, 50.0),
        ("partially_contradicts", "fact_check", False, 0.3, True, 40.0),
        ("neutral", None, None, None, False, 50.0),
        ("contradicts", None, None, None, False, 20.0),
        ("partially_supports", "unknown", False, 0.8, True, 50.0),
    ]
    df = spark.createDataFrame(rows, "rel string, kind string, ind boolean, cred double, has boolean, want double")
    got = df.select("want", rules.evidence_score(*[F.col(c) for c in ("rel", "kind", "ind", "cred", "has")]).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_engine_confidence_limits(spark):
    rows = [(0, 0, 0, 0, 0.3), (1, 0, 0, 0, 0.3), (0, 0, 0, 3, 0.3), (20, 0, 0, 20, 0.99), (1, 2, 0, 1, 0.5 - 0.01 + 0.09 + 0.02)]
    df = spark.createDataFrame(rows, "s int, c int, n int, t int, want double")
    got = df.select("want", rules.engine_confidence(*[F.col(c) for c in "scnt"]).alias("got")).collect()
    assert all(abs(r["want"] - r["got"]) < 1e-12 for r in got)


def results(spark, rows):
    return spark.createDataFrame(
        rows, "claim_id long, query_no int, rank int, url string, title string, snippet string, published_date string, score double"
    )


def test_verify_small_batch(spark):
    requests = spark.createDataFrame([(1,), (2,)], "request_id long")
    claims = spark.createDataFrame([(10, 1, "The mayor said the bridge will open"), (20, 2, "short claim")], "claim_id long, request_id long, text string")
    found = results(
        spark,
        [
            (10, 0, 1, "https://city.gov/a", "Officials confirm", "x" * 20, None, 1.0),
            (10, 1, 1, "https://city.gov/a", "Fake repeat", "x" * 600, None, 1.0),
            (10, 1, 2, "https://dailynews.com/b", "A myth", "y" * 19, None, 1.0),
            (10, 2, 1, "", "Official", "z" * 30, None, 1.0),
            (10, 2, 2, "https://blog.example/c", "Plain", "w" * 501, None, 1.0),
        ],
    )
    run = vp.verify(requests, claims, found)
    assert sorted(values(run.sources, "url", "source_type", "credibility_score")) == [
        ("https://blog.example/c", "unknown", 0.5), ("https://city.gov/a", "primary", 0.85), ("https://dailynews.com/b", "secondary", 0.7),
    ]
    assert sorted((u, r, len(t)) for u, r, t in values(run.evidence, "url", "relation", "text")) == [
        ("https://blog.example/c", "neutral", 500), ("https://city.gov/a", "supports", 20),
    ]
    verdicts = {r["request_id"]: r for r in run.verdicts.collect()}
    assert (verdicts[1]["score"], verdicts[1]["verdict"], round(verdicts[1]["confidence"], 6)) == (63, "partially_true", 0.55)
    assert verdicts[1]["limitations"] == ""
    assert (verdicts[2]["verdict"], verdicts[2]["evidence_strength"], verdicts[2]["confidence"]) == ("unverified", "UNKNOWN", 0.3)
    assert verdicts[2]["limitations"] == "Limited number of sources analyzed; No primary sources found"


def test_search_merge_cap(spark):
    claims = spark.createDataFrame([(1, 1, "a b"), (2, 1, "a b c d e f")], "claim_id long, request_id long, text string")
    rows = [(c, n % 6, n, f"u{n}", "t", "s", None, 0.0) for c in (1, 2) for n in range(50)]
    merged = ev.merge_search_results(results(spark, rows), claims)
    assert sorted(values(merged.groupBy("claim_id").count(), "claim_id", "count")) == [(1, 20), (2, 30)]


def test_source_independence_and_groups(spark):
    df = spark.createDataFrame([(1, "a.com", "https://a.com/1"), (1, "b.com", "https://b.com"), (1, "a.com", "https://a.com/2")], "request_id long, domain string, url string")
    row = ev.source_independence(df).first()
    assert (row["total_sources"], row["independent_sources"], row["dependent_groups"]) == (3, 1, 1)
    assert values(ev.dependent_source_groups(df), "domain", "n_sources", "urls") == [("a.com", 2, ["https://a.com/1", "https://a.com/2"])]


def test_headline_penalties(spark):
    df = spark.createDataFrame([(1, 5, 1, 2, 4, 2, True, True)], "request_id long, supporting long, contradicting long, neutral long, n_sources long, n_primary long, exaggeration_detected boolean, headline_body_contradiction boolean")
    row = vd.verdict_rows(df).first()
    assert row["score"] == 50 + 25 + 20 - 8 - 4 - 10 - 15
    assert row["limitations"] == "Headline exaggeration detected"
    assert row["factors"][-1] == "headline exaggeration detected"


def test_empty_scan_article(spark):
    articles = spark.createDataFrame([(1, "", ""), (2, "t", "s")], "article_id long, title string, snippet string")
    counts = spark.createDataFrame([(9, 0, 0, 0, 0)], "article_id long, evidence_count long, supporting long, contradicting long, claims_checked long")
    rows = {r["article_id"]: r for r in sc.scan_verdicts(articles, counts).collect()}
    assert (rows[1]["verdict"], rows[1]["confidence"], rows[1]["reason"]) == ("unverified", 0.0, "No content to verify")
    assert (rows[2]["verdict"], rows[2]["confidence"], rows[2]["score"]) == ("unverified", 0.3, 50)
