"""Source registry: a JSON document with two arrays of sources."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.schemas import REGISTRY_SOURCE

# Array names and the list kind each stands for.
LISTS = {"news_sources": "news", "article_sources": "article"}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows with list kind and position; a missing array or file is empty."""
    schema = ", ".join(f"{name} array<struct<{_struct_body()}>>" for name in LISTS)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        raw = spark.read.schema(schema).json(path, multiLine=True)
    else:
        raw = spark.createDataFrame([], schema)
    parts = [
        raw.select(F.lit(kind).alias("list_kind"), F.posexplode(F.col(name)).alias("seq", "s"))
        for name, kind in LISTS.items()
    ]
    return parts[0].unionByName(parts[1]).select(
        "list_kind", "seq", "s.name", F.col("s.url").alias("source_url"), "s.country", "s.category",
        "s.language", "s.credibility",
    )


def _struct_body() -> str:
    return ",".join(f.strip().replace(" ", ":") for f in REGISTRY_SOURCE.split(","))
