"""Stored search answers of three JSON shapes to one result schema."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload shapes. Each names the path to the list and, per output
# column, the field it comes from; ``score`` is a field name or a constant.
SHAPES = {
    "tavily": {
        "path": "results", "url": "url", "snippet": "content", "date": "published_date", "score": "score",
    },
    "brave": {
        "path": "web.results", "url": "url", "snippet": "description", "date": "page_age", "score": "score",
    },
    "serpapi": {
        "path": "organic_results", "url": "link", "snippet": "snippet", "date": "date", "score": 1.0,
    },
}


def _items(payload: Column, shape: dict) -> Column:
    fields = [f"title:string,{shape['url']}:string,{shape['snippet']}:string,{shape['date']}:string"]
    if isinstance(shape["score"], str):
        fields.append(f"{shape['score']}:double")
    schema = f"array<struct<{','.join(fields)}>>"
    for level in reversed(shape["path"].split(".")):
        schema = f"struct<{level}:{schema}>"
    items = F.from_json(payload, schema)
    for level in shape["path"].split("."):
        items = items[level]
    score = F.lit(shape["score"]) if not isinstance(shape["score"], str) else None
    return F.transform(
        items,
        lambda s: F.struct(
            F.coalesce(s[shape["url"]], F.lit("")).alias("url"),
            F.coalesce(s["title"], F.lit("")).alias("title"),
            F.coalesce(s[shape["snippet"]], F.lit("")).alias("snippet"),
            F.coalesce(s[shape["url"]], F.lit("")).alias("source"),
            (score if score is not None else F.coalesce(s[shape["score"]], F.lit(0.0))).alias("score"),
            s[shape["date"]].alias("published_date"),
        ),
    )


def normalize_payloads(df: DataFrame, payload: str = "payload", provider: str = "provider") -> DataFrame:
    """One row per result with ``rank`` (1-based position), in one pass over all
    providers; malformed payloads give no rows."""
    items = None
    for name, shape in SHAPES.items():
        test = F.col(provider) == name
        items = F.when(test, _items(F.col(payload), shape)) if items is None else items.when(
            test, _items(F.col(payload), shape)
        )
    others = [c for c in df.columns if c != payload]
    return df.select(*others, F.posexplode(items).alias("__pos", "r")).select(
        *others, (F.col("__pos") + 1).alias("rank"), "r.*"
    )
