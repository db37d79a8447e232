"""Batch prediction and explained prediction with a fitted model.

One narrow plan from scan to sink: the model is a literal, so no row is shuffled and
the input columns stay in place.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.config import NUMERIC_FEATURES
from credlake.errors import EmptyInputError
from credlake.functions import text as tx
from credlake.operators import corpus, linear, vectorize
from credlake.operators.linear import DISCLAIMER, LinearModel
from credlake.operators.vectorize import FeatureSpace
from credlake.sources.news_files import detect_columns


def _features(df: DataFrame, space: FeatureSpace, max_chars: int | None) -> DataFrame:
    """Input columns plus ``idx``, ``val`` and the validity flag."""
    roles = detect_columns(df.columns)
    if roles["title"] is None and roles["text"] is None:
        raise EmptyInputError(
            "Could not find a title or text column. Expected a column such as 'title', "
            "'headline', 'text', 'article' or 'content'."
        )

    def role(name: str):
        return F.lit("") if roles[name] is None else F.col(f"`{roles[name]}`").cast("string")

    content = tx.combine_title_text(role("title"), role("text"))
    if max_chars is not None:
        content = tx.truncate(content, max_chars)
    staged = df.withColumn("__content", content).withColumn("__valid", ~tx.is_blank(F.col("__content")))
    cleaned = corpus.with_clean_text(staged, space.settings, content="__content")
    rows = vectorize.transform(corpus.with_style(cleaned, content="__content"), space)
    return rows.drop(*NUMERIC_FEATURES, "clean_text", "__content")


def predict_batch(df: DataFrame, space: FeatureSpace, model: LinearModel, max_chars: int | None = None) -> DataFrame:
    """The input with prediction, confidence and confidence_level added; rows without
    text keep null, null, Unknown. Texts are scored whole unless ``max_chars`` is given."""
    scored = linear.with_score(_features(df, space, max_chars), model)
    decided = linear.with_decisions(scored, space.settings)
    return decided.select(*df.columns, "prediction", "confidence", "confidence_level")


def predict_explained(df: DataFrame, space: FeatureSpace, model: LinearModel, n: int = 10, max_chars: int | None = None) -> DataFrame:
    """Batch prediction plus the strongest features of each row and model facts."""
    scored = linear.with_score(_features(df, space, max_chars), model)
    explained = scored.withColumn(
        "top_features", F.when(F.col("__valid"), linear.top_features(model, space, n))
    )
    decided = linear.with_decisions(explained, space.settings)
    return decided.select(
        *df.columns,
        "prediction",
        "confidence",
        "confidence_level",
        F.lit(model.is_probability).alias("is_calibrated_probability"),
        F.lit(model.name).alias("model"),
        "top_features",
        F.lit(DISCLAIMER).alias("disclaimer"),
    )
