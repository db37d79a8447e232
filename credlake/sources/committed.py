"""Stored results under commits: retries write nothing twice, deletes rewrite only touched files.

A store is a folder. A commit writes its rows to ``<table>/run=<run>/bucket=<n>/`` and then one
small table ``commits/run=<run>`` that names the files it adds and those it takes out of use.
Live files are those that some commit adds and none takes out; readers open only them, so files
of a run that failed before its commit are never read and its retry overwrites them.

A run that is committed already is left as it is, so a retry after the commit changes nothing
either. Deletes expect one deleting writer at a time. Names of files go through the driver, as
Spark's own listing of a table does; rows never do.
"""
from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.errors import DataValidationError
from credlake.operators.common import checkpoint_dir
from credlake.schemas import TABLES

#: Buckets of a commit, by request; every commit records its own number, so it may follow the size of a run.
BUCKETS = 16
COMMIT = "run string, table string, file string, bucket int, buckets int, live boolean"
LAYOUT = ", run string, bucket int"


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """All commits; a folder that doesn't exist holds none."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def _file() -> Column:
    """Name of a row's file below its table's folder."""
    return F.regexp_extract("_metadata.file_path", "(run=[^/]+/bucket=[^/]+/[^/]+)$", 1)


def _bucket(request: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(request.cast("string")), buckets).cast("int")


def committed(spark: SparkSession, root: str, run: str) -> bool:
    """Whether a run is in the store."""
    return not _commits(spark, root).where(F.col("run") == run).isEmpty()


def live_files(spark: SparkSession, root: str) -> DataFrame:
    """table, file, bucket, buckets of the files in use."""
    files = _commits(spark, root).where("file is not null")
    state = files.groupBy("table", "file").agg(F.min("live").alias("live"), F.max("bucket").alias("bucket"), F.max("buckets").alias("buckets"))
    return state.where("live").drop("live")


def _open(spark: SparkSession, root: str, name: str, files: list[str]) -> DataFrame:
    schema = TABLES[name] + LAYOUT
    if not files:
        return spark.createDataFrame([], schema)
    folder = f"{root}/{name}"
    return spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/{f}" for f in files])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All committed rows of a table."""
    files = [r["file"] for r in live_files(spark, root).where(F.col("table") == name).select("file").collect()]
    return _open(spark, root, name, files).drop("run", "bucket")


def read_result(spark: SparkSession, root: str, request_id) -> dict[str, DataFrame]:
    """Rows of one request from every table: only files of its bucket are opened, and the
    filter on the id, by which files are sorted, is pushed to parquet."""
    request = F.lit(str(request_id))
    found = live_files(spark, root).where(F.col("bucket") == _bucket(request, F.col("buckets")))
    files: dict[str, list[str]] = {name: [] for name in TABLES}
    for row in found.select("table", "file").collect():
        files[row["table"]].append(row["file"])
    return {name: _open(spark, root, name, files[name]).drop("run", "bucket").where(F.col("request_id") == request) for name in TABLES}


def _write(rows: DataFrame, root: str, name: str, run: str, buckets: int) -> DataFrame:
    """Write rows of a run, by name and with the table's types; gives the files as commit rows.

    Rows are range-partitioned by bucket, request and own key, so a request that holds a third
    of all rows is spread over tasks, and files are sorted by request.
    """
    fields = [f.strip().split(" ") for f in TABLES[name].split(",")]
    have = set(rows.columns)
    typed = rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields])
    placed = typed.withColumn("bucket", _bucket(F.col("request_id"), F.lit(buckets)))
    key = list(dict.fromkeys(["bucket", "request_id", fields[0][0]]))
    folder = f"{root}/{name}/run={run}"
    placed.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    spark = rows.sparkSession
    written = spark.read.schema(TABLES[name] + LAYOUT).option("basePath", f"{root}/{name}").parquet(folder)
    return written.select(F.lit(name).alias("table"), _file().alias("file"), "bucket").distinct().select(
        F.lit(run).alias("run"), "table", "file", "bucket", F.lit(buckets).alias("buckets"), F.lit(True).alias("live")
    )


def _publish(spark: SparkSession, root: str, run: str, entries: list[DataFrame]) -> None:
    """Write the commit: one file, which appears as a whole; a row without a file marks an empty run."""
    rows = spark.createDataFrame([(run, None, None, None, None, True)], COMMIT)
    for entry in entries:
        rows = rows.unionByName(entry)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{run}")


def _checked(run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9-]+", run):
        raise DataValidationError(f"A run's name is made of letters, digits and '-', not '{run}'.")
    return run


def commit(spark: SparkSession, root: str, run: str, tables: dict[str, DataFrame], buckets: int = BUCKETS) -> bool:
    """Add the rows of a run to the tables, all of them or none; False if the run was committed before."""
    if committed(spark, root, _checked(run)):
        return False
    _publish(spark, root, run, [_write(df, root, name, run, buckets) for name, df in tables.items()])
    return True


def delete_requests(spark: SparkSession, root: str, run: str, ids: DataFrame, buckets: int = BUCKETS) -> bool:
    """Take the given requests and their children out of every table, copy on write.

    Only files that hold such a row are rewritten, without it; all others keep their names.
    Ids that are null or unknown delete nothing. False if the run was committed before.
    """
    if committed(spark, root, _checked(run)):
        return False
    gone = f"{checkpoint_dir(spark)}/deleted-{run}"
    known = ids.select(F.col("request_id").cast("string").alias("request_id")).where("request_id is not null").distinct()
    known.write.mode("overwrite").parquet(gone)
    known = spark.read.schema("request_id string").parquet(gone)
    files: dict[str, list[str]] = {}
    for row in live_files(spark, root).select("table", "file").collect():
        files.setdefault(row["table"], []).append(row["file"])
    entries = []
    for name, names in files.items():
        held = _open(spark, root, name, names).select("request_id", _file().alias("file"), "bucket")
        touched = held.join(known, "request_id", "left_semi").select("file", "bucket").distinct().collect()
        if touched:
            out = [(run, name, r["file"], r["bucket"], None, False) for r in touched]
            rest = _open(spark, root, name, [r["file"] for r in touched]).join(known, "request_id", "left_anti")
            entries += [spark.createDataFrame(out, COMMIT), _write(rest, root, name, run, buckets)]
    _publish(spark, root, run, entries)
    return True
