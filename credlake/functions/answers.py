"""Stored model answers: JSON text to typed structs, with defaults when malformed."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAIM_FIELDS = [
    "text", "subject", "action", "object", "location", "date_time", "numerical_values", "entities",
    "certainty_level",
]
CLAIM_TYPE = "struct<" + ",".join(f"{name}:string" for name in CLAIM_FIELDS) + ">"

# Answer kinds with their fields and the values used for a bad answer.
ANSWER_TYPES = {
    "opinion": "is_factual boolean, is_opinion boolean, factual_claims array<string>, "
    "opinion_parts array<string>, reasoning string",
    "comparison": "assessment string, confidence double, reasoning string, key_factors array<string>",
    "headline": "clickbait_score double, exaggeration_detected boolean, "
    "headline_body_contradiction boolean, notes array<string>",
    "temporal": "is_outdated boolean, is_future_dated boolean, notes string",
    "media_reuse": "is_reused boolean, original_context string, current_context string, confidence double",
}
ANSWER_DEFAULTS = {
    "opinion": {"is_factual": True, "is_opinion": False, "reasoning": "Default assumption"},
    "comparison": {
        "assessment": "neutral",
        "confidence": 0.5,
        "reasoning": "Unable to compare evidence automatically.",
        "key_factors": [],
    },
    "headline": {
        "clickbait_score": 0.0,
        "exaggeration_detected": False,
        "headline_body_contradiction": False,
        "notes": ["Analysis could not be completed."],
    },
    "temporal": {
        "is_outdated": False,
        "is_future_dated": False,
        "notes": "Date analysis could not be completed.",
    },
    "media_reuse": {"is_reused": False, "original_context": "", "confidence": 0.0},
}


def is_json(col: Column) -> Column:
    return F.try_parse_json(col).isNotNull()


def parse_answer(col: Column, kind: str, overrides: dict[str, Column] | None = None) -> Column:
    """Typed struct of an answer; the kind's default struct when it is not JSON.

    ``overrides`` puts columns into the default struct (the media answer repeats
    the caption it was asked about).
    """
    defaults = {**ANSWER_DEFAULTS[kind], **(overrides or {})}
    fields = [item.strip().split(" ", 1) for item in ANSWER_TYPES[kind].split(", ")]
    parts = []
    for name, type_name in fields:
        value = defaults.get(name)
        if isinstance(value, list):
            column = F.array(*[F.lit(v) for v in value])
        elif isinstance(value, Column):
            column = value
        else:
            column = F.lit(value)
        parts.append(column.cast(type_name).alias(name))
    return F.when(is_json(col), F.from_json(col, ANSWER_TYPES[kind])).otherwise(F.struct(*parts))


def headline_analysis(answer: Column, input_type: Column, title: Column, text: Column) -> Column:
    """Headline flags for URL input that has both title and text, zeros otherwise."""
    applies = (
        (input_type == "url")
        & (F.coalesce(title, F.lit("")) != "")
        & (F.coalesce(text, F.lit("")) != "")
    )
    zeros = F.struct(
        F.lit(0.0).alias("clickbait_score"),
        F.lit(False).alias("exaggeration_detected"),
        F.lit(False).alias("headline_body_contradiction"),
        F.array().cast("array<string>").alias("notes"),
    )
    parsed = parse_answer(answer, "headline")
    kept = F.struct(
        F.coalesce(parsed["clickbait_score"], F.lit(0.0)).alias("clickbait_score"),
        F.coalesce(parsed["exaggeration_detected"], F.lit(False)).alias("exaggeration_detected"),
        F.coalesce(parsed["headline_body_contradiction"], F.lit(False)).alias(
            "headline_body_contradiction"
        ),
        F.coalesce(parsed["notes"], F.array().cast("array<string>")).alias("notes"),
    )
    return F.when(applies, kept).otherwise(zeros)


def claim_list(answer: Column, text: Column) -> Column:
    """Claims of a stored answer: a JSON array, or an object's ``claims``; anything
    else gives one fallback claim holding the whole text."""
    body = F.trim(answer)
    valid = is_json(answer)
    as_array = F.when(valid & body.startswith("["), F.from_json(answer, f"array<{CLAIM_TYPE}>"))
    as_object = F.when(
        valid & body.startswith("{"), F.from_json(answer, f"claims array<{CLAIM_TYPE}>")["claims"]
    )
    claims = F.coalesce(as_array, as_object)
    fixed = {"text": text, "subject": "", "action": "", "object": "", "certainty_level": "medium"}
    fallback = F.array(
        F.struct(
            *[
                (fixed[n] if isinstance(fixed.get(n), Column) else F.lit(fixed.get(n)))
                .cast("string")
                .alias(n)
                for n in CLAIM_FIELDS
            ]
        )
    )
    return F.when(F.size(claims) > 0, claims).otherwise(fallback)
