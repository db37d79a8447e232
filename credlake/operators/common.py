"""Helpers the operators share: storage, first rows, pages."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credlake.errors import SharedFolderError


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as ``spark.checkpoint.dir`` names it.

    There is no fallback: a machine-local folder would lose rows on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise SharedFolderError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write an intermediate table once and read it back: cuts lineage and survives
    the loss of executors, unlike a block cache. ``options`` are the writer's."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by a hash of ``keys`` to four tasks a core.

    A file's row group is one task's, however long, and the work on its texts would stay there.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def first_by(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """First row per key by an explicit order.

    ``min_by`` aggregates partially, so copies of a hot key collapse before the
    shuffle; the order columns must make rows of one key distinct.
    """
    key_columns = [k if isinstance(k, Column) else F.col(k) for k in keys]
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    names = [f"__k{i}" for i in range(len(key_columns))]
    grouped = df.groupBy(*[k.alias(n) for k, n in zip(key_columns, names)]).agg(
        F.min_by(row, rank).alias("__row")
    )
    return grouped.select("__row.*")


def first_rows(df: DataFrame, keys: list[str | Column], row_id: list[str]) -> DataFrame:
    """First row per key by the columns that identify a row, materialised late.

    Only keys and ids are aggregated; the wide columns join back by id, so no text stands in an
    aggregation and copies of a hot key are spread by their ids. Ids aren't null and name one row
    of ``df`` each; ``df`` is read twice and must give the same rows both times.
    """
    key_columns = [k if isinstance(k, Column) else F.col(k) for k in keys]
    names = [f"__k{i}" for i in range(len(key_columns))]
    narrow = df.select(*[k.alias(n) for k, n in zip(key_columns, names)], *[F.col(c).alias(f"__id_{c}") for c in row_id])
    ids = [f"__id_{c}" for c in row_id]
    if len(ids) == 1:
        first = narrow.groupBy(*names).agg(F.min(ids[0]).alias(ids[0])).select(*ids)
    else:
        first = narrow.groupBy(*names).agg(F.min(F.struct(*ids)).alias("__first")).select("__first.*")
    same = [F.col(c) == F.col(i) for c, i in zip(row_id, ids)]
    return df.join(first, reduce(lambda a, b: a & b, same), "left_semi")


def numbered(df: DataFrame, key: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """Add a row's number within its key, from 0, by ``order``.

    Rows are range-partitioned by key and order and written so; counts per (key, range) give
    each range's offset, and rows are ranked inside (key, range) only. A key that holds a
    third of all rows so spans a third of the ranges. A null key is a key like any other.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in key], *order).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy(*key, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before")
    offsets = counts.select(*[F.col(k).alias(f"__of_{k}") for k in key], F.col("__range").alias("__of_range"), before)
    inside = Window.partitionBy(*key, "__range").orderBy(*order)
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in key]
    placed = ranged.join(offsets, reduce(lambda a, b: a & b, same, F.col("__range") == F.col("__of_range")))
    number = F.col("__before") + F.row_number().over(inside) - 1
    return placed.withColumn(name, number).select(*df.columns, name)


def paged(df: DataFrame, key: list[str], item: str, size: int) -> DataFrame:
    """Add ``page``: rows of a key in item order, ``size`` to a page, alike at every size.

    Rows are numbered in ranges of (key, item), so a key with very many rows is no single task's.
    """
    return numbered(df, key, [F.col(item)], "__number").withColumn("page", F.floor(F.col("__number") / size).cast("int")).drop("__number")
