"""Derived views over the driver tables, in Spark.

The driver tables hold no news requests, search results or registry, so these views
shape them into such tables by arithmetic on ids. ``sql_views`` holds the same views
as SQL text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.functions.rules import CATEGORIES
from credlake.functions.text import coerce_label
from credlake.operators import corpus, evidence, linear, vectorize
from credlake.operators.common import materialize, spread

# Fixed values of the views.
TITLE_PREFIXES = ["Officials confirm ", "Fake: ", "Announcement: ", "Myth of ", "Fact check: ", "", ""]
HOSTS = ["agency.gov", "uni.edu", "politifact.com", "bbc.com", "dailynews.com"]
MODELS = ["LogisticRegression", "MultinomialNB", "LinearSVC", "PassiveAggressiveClassifier"]
N_REQUESTS = 17


# Schemas of the driver tables that are read here; given, they need not be inferred.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    """Value at a small 0-based index, null beyond the list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, title, text, label (REAL/FAKE text or null), source, lang."""
    quality = F.col("quality")
    return (
        spread(table(spark, sf, "documents"), "doc_id")
        .join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
        .select(
            "doc_id",
            F.substring_index("text", ".", 1).alias("title"),
            "text",
            F.when(quality == 0, "FAKE").when(quality == 1, "REAL").alias("label"),
            "source",
            "lang",
        )
    )


def coded_news(spark: SparkSession, sf: str) -> DataFrame:
    return news(spark, sf).withColumn("label", coerce_label(F.col("label")))


def clean_news(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled, de-duplicated articles with content and split."""
    rows = corpus.clean_dataset(coded_news(spark, sf), ["doc_id"])
    return corpus.with_split(rows, F.col("doc_id"))


def engineered_news(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.add_engineered_columns(clean_news(spark, sf))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        item.alias("claim_id"),
        (item % N_REQUESTS).alias("request_id"),
        "text",
        pick(item % len(CATEGORIES), CATEGORIES).alias("category"),
        pick(item % 3, ["high", "medium", "low"]).alias("certainty_level"),
    )


def page_title_text() -> Column:
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


def page_results(spark: SparkSession, sf: str) -> DataFrame:
    """Search results, one per document: its text is the snippet, url and title come from the page that its number comes to."""
    page = F.col("doc_id")
    n_pages = table(spark, sf, "pages").agg(F.count(F.lit(1))).scalar()
    path = F.regexp_extract("url", "^https?://[^/]+(/[a-z]*)", 1)
    host = pick(page % 8, HOSTS)
    return (
        table(spark, sf, "documents")
        .select("doc_id", "text", (page % F.nullif(n_pages, F.lit(0))).alias("on"))
        .join(table(spark, sf, "pages"), F.col("page_id") == F.col("on"))
        .select(
            page.alias("rank"),
            F.when(host.isNotNull(), F.concat(F.lit("https://"), host, path)).otherwise(F.col("url")).alias("url"),
            F.concat(pick(page % 7, TITLE_PREFIXES), page_title_text()).alias("title"),
            F.when(page % 11 == 0, "Brief note").otherwise(F.col("text")).alias("snippet"),
            F.concat(F.lit("2024-0"), (page % 9 + 1).cast("string"), F.lit("-15")).alias("published_date"),
            ((page % 100) / 100.0).alias("score"),
            F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source_url"),
        )
    )


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results spread over the claims: page p answers claim p mod n."""
    n_claims = table(spark, sf, "benchmark").agg(F.count(F.lit(1))).scalar()
    return page_results(spark, sf).select(
        (F.col("rank") % n_claims).alias("claim_id"),
        (F.floor(F.col("rank") / n_claims) % 6).alias("query_no"),
        "rank", "url", "title", "snippet", "published_date", "score",
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Merged search results with their claims."""
    c = claims(spark, sf)
    return evidence.claim_results(c, evidence.merge_search_results(search_results(spark, sf), c))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.unique_sources(evidence.source_rows(candidates(spark, sf)))


def evidence_items(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.evidence_rows(candidates(spark, sf))


def sources_and_evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both tables from merged candidates that are written once."""
    shared = materialize(candidates(spark, sf), "candidates")
    return evidence.unique_sources(evidence.source_rows(shared)), evidence.evidence_rows(shared)


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    """Headline flags of the requests that have claims."""
    request = F.col("request_id")
    return claims(spark, sf).select("request_id").distinct().select(
        "request_id",
        (request % 5 == 0).alias("exaggeration_detected"),
        (request % 7 == 0).alias("headline_body_contradiction"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Verification requests: one per event, about the document that its number comes to."""
    event = F.col("event_id")
    n_documents = table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    return (
        table(spark, sf, "events")
        .select("event_id", "ts", (event % F.nullif(n_documents, F.lit(0))).alias("about"))
        .join(table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id") == F.col("about"))
        .select(
            event.alias("request_id"),
            pick(event % 4, ["url", "headline", "article", "claim"]).alias("input_type"),
            F.col("text").alias("original_text"),
            F.when(event % 10 == 9, "failed").otherwise("processing").alias("status"),
            F.col("ts").alias("created_at"),
        )
    )


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct page hosts as registry sources; ``seq`` is a hash order."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    number = F.conv(F.substring(F.md5("source_url"), 1, 8), 16, 10).cast("long")
    return (
        table(spark, sf, "pages")
        .groupBy(host.alias("source_url"))
        .agg(F.min(F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)).alias("language"))
        .select(
            "source_url",
            F.concat(F.lit("Site "), "source_url").alias("name"),
            pick(number % 3, ["FR", "DE", "US"]).alias("country"),
            pick(number % 4, ["news", "science", "local"]).alias("category"),
            "language",
            pick(number % 3, ["high", "medium-high", "medium"]).alias("credibility"),
            pick(number % 2, ["news", "article"]).alias("list_kind"),
            number.alias("seq"),
        )
    )


def site_results(spark: SparkSession, sf: str) -> DataFrame:
    return page_results(spark, sf).select(
        "source_url", "rank", "url", "title", "snippet", "published_date"
    )


def scan_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned articles: every page, some without title and snippet."""
    page = F.col("rank")
    keep = page % 13 != 0
    return page_results(spark, sf).select(
        page.alias("article_id"),
        F.when(keep, F.col("title")).otherwise("").alias("title"),
        F.when(keep, F.col("snippet")).otherwise("").alias("snippet"),
        "url",
    )


def article_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results found for scanned articles: page p belongs to article p div 5, claim p mod 2."""
    page = F.col("rank")
    return page_results(spark, sf).select(
        F.floor(page / 5).alias("article_id"), (page % 2).alias("claim_id"), "rank", "title"
    )


def media(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("media_id"),
        F.col("user_id").alias("request_id"),
        F.when(F.col("event_type").isin("click", "view"), "image").otherwise("video").alias("media_type"),
        (F.col("value") > 20).alias("is_reused"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Hash-based scores of four models for every labelled article, with ties."""
    digest = F.md5(F.concat("model", F.lit(":"), F.col("doc_id").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = corpus.labelled(coded_news(spark, sf)).select(
        "doc_id", "label", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")
    )
    # pulled towards the label a little, so that the curves are not a plain diagonal
    pulled = F.when(F.col("label") == 1, F.sqrt(number)).otherwise(number)
    scored = rows.withColumn("score", F.floor(pulled * 1000.0) / 1000.0)
    return linear.with_prediction(scored)


def clean_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned texts of the corpus, written once: statistics and weights both read them."""
    rows = corpus.with_clean_text(clean_news(spark, sf))
    return materialize(rows.select("doc_id", "label", "split", "clean_text"), "clean-texts")


def vocabulary(rows: DataFrame) -> DataFrame:
    """Vocabulary of the training split of prepared rows."""
    train = rows.filter(F.col("split") == "train")
    stats = vectorize.term_statistics(vectorize.with_terms(train).select("terms"))
    n_docs = train.agg(F.count(F.lit(1))).scalar()
    return vectorize.vocabulary(stats, n_docs)
