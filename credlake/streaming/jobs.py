"""Streaming forms of three batch paths: scoring, feed ingestion, verdict counts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credlake.functions.text import is_blank
from credlake.operators.linear import LinearModel
from credlake.operators.vectorize import FeatureSpace
from credlake.plans.prediction import predict_batch


def read_files(spark: SparkSession, path: str, schema, file_format: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Stream of files dropped into a folder."""
    return (
        spark.readStream.schema(schema)
        .format(file_format)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )


def score_articles(articles: DataFrame, space: FeatureSpace, model: LinearModel, max_chars: int | None = None) -> DataFrame:
    """Score arriving articles; the same narrow plan as in batch, without state."""
    return predict_batch(articles, space, model, max_chars)


def first_seen(articles: DataFrame, delay: str = "1 day", time: str = "ts", url: str = "url") -> DataFrame:
    """Drop URLs seen before within the watermark. State holds one entry per URL and
    is cleared once the watermark passes it."""
    kept = articles.filter(~is_blank(F.col(url)))
    return kept.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])


def verdict_windows(verdicts: DataFrame, delay: str = "1 hour", width: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Verdicts per tumbling window and verdict; counts combine before the shuffle."""
    return (
        verdicts.withWatermark(time, delay)
        .groupBy(F.window(time, width), "verdict")
        .agg(F.count(F.lit(1)).alias("n_checks"))
        .select(F.col("window.start").alias("window_start"), "verdict", "n_checks")
    )


def first_rows(articles: DataFrame, time: str = "ts", url: str = "url", ties: tuple[str, ...] = ()) -> DataFrame:
    """The earliest row of each URL by event time, then by ``ties``; rows without a time come last,
    blank URLs go. The rows of a batch or the first rows of many batches go in alike."""
    order = F.struct(F.col(time).isNull(), time, *ties)
    rest = F.struct(*[c for c in articles.columns if c != url])
    first = articles.filter(~is_blank(F.col(url))).groupBy(url).agg(F.min_by(rest, order).alias("row"))
    return first.select(url, "row.*").select(*articles.columns)


def window_counts(verdicts: DataFrame, width: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Counts of a batch per tumbling window and verdict; rows without a time belong to no window."""
    counts = verdicts.groupBy(F.window(time, width), "verdict").agg(F.count(F.lit(1)).alias("n_checks"))
    return counts.select(F.col("window.start").alias("window_start"), "verdict", "n_checks")


def window_totals(counts: DataFrame) -> DataFrame:
    """Totals per window and verdict over the counts of all batches."""
    return counts.groupBy("window_start", "verdict").agg(F.sum("n_checks").alias("n_checks"))


def batch_sink(reduced: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Writes what a batch reduces to in a folder of its number. A batch that is run again after a
    failure replaces its own folder, so it counts once; no row is too late, and no state is held."""

    def put(batch: DataFrame, number: int) -> None:
        reduced(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def write_batches(df: DataFrame, reduced: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Reduce each batch of a stream and keep the results by batch; readers reduce them once more."""
    writer = df.writeStream.foreachBatch(batch_sink(reduced, path)).option("checkpointLocation", checkpoint).outputMode("update")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_parquet(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to parquet; exactly once, by the checkpoint and the sink log."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
