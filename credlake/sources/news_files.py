"""Labelled news files: layout detection, alias columns, scans."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credlake.config import FAKE, REAL
from credlake.errors import DataValidationError
from credlake.functions.text import coerce_label
from credlake.schemas import TRUTH_COLUMNS, TRUTH_FAKE_LABELS

# Column names understood for each role.
ALIASES = {
    "title": ["title", "headline", "news_title", "head"],
    "text": ["text", "article", "content", "body", "news_text", "articles", "statement"],
    "label": ["label", "class", "target", "type", "news_type"],
}
# Cell texts that mean a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def detect_columns(columns: list[str]) -> dict[str, str | None]:
    """Column playing each role: the first in file order whose name is an alias."""
    normal = {c: c.strip().lower().replace(" ", "_").replace("-", "_") for c in columns}
    return {
        role: next((c for c in columns if normal[c] in names), None)
        for role, names in ALIASES.items()
    }


def _list_tables(spark: SparkSession, folder: str) -> list[str] | None:
    """Paths of csv/tsv tables in a folder of any file system; null when it is missing.

    A table is a file or, as Spark writes them, a folder with such a name.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    paths = [str(status.getPath().toString()) for status in fs.listStatus(path)]
    return sorted(p for p in paths if PurePosixPath(p).suffix in (".csv", ".tsv"))


def find_layout(spark: SparkSession, folder: str) -> dict:
    """``paired`` when there are a fake.* and a true.* file, else ``single`` files."""
    paths = _list_tables(spark, folder)
    if paths is None:
        raise DataValidationError(f"Raw data directory not found: {folder}. Create it and add your dataset.")
    stems = {p: PurePosixPath(p).stem.lower() for p in paths}
    fake = next((p for p in paths if stems[p] == "fake"), None)
    true = next((p for p in paths if stems[p] == "true"), None)
    if fake and true:
        return {"mode": "paired", "fake": fake, "true": true}
    singles = [p for p in paths if stems[p] not in ("fake", "true")]
    if singles:
        return {"mode": "single", "files": singles}
    raise DataValidationError(
        f"No usable CSV/TSV files found in {folder}. Place either 'Fake.csv' and 'True.csv', "
        "or a CSV with title/text/label columns, in this directory."
    )


def _raw(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Tables of one separator and header as strings; quoted texts may hold line ends."""
    reader = spark.read
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    sep = "\t" if paths[0].lower().endswith(".tsv") else ","
    return reader.csv(paths, header=True, sep=sep, multiLine=True, quote='"', escape='"')


def _presented(raw: DataFrame, *more: Column) -> DataFrame:
    """Missing-value tokens as null."""
    return raw.select(*[_present(F.col(f"`{c}`")).alias(c) for c in raw.columns], *more)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Header file as strings, separator by suffix, missing-value tokens as null."""
    return _presented(_raw(spark, [path]))


def _present(col: Column) -> Column:
    return F.when(~col.isin(NULL_TOKENS), col)


def standard_columns(df: DataFrame, name: str, need_label: bool, label: Column | None = None, *keys: Column) -> DataFrame:
    """Project any table to title, text, label (and ``keys``); raise when a role cannot be filled."""
    roles = detect_columns(df.columns)
    if need_label and roles["label"] is None:
        raise DataValidationError(
            f"Could not find a label column in '{name}'. Expected one of {sorted(ALIASES['label'])}."
        )
    if roles["title"] is None and roles["text"] is None:
        expected = sorted(ALIASES["title"] + ALIASES["text"])
        raise DataValidationError(
            f"Could not find a title or text column in '{name}'. Expected one of {expected}."
        )

    def role(which: str) -> Column:
        column = roles[which]
        return F.lit("") if column is None else F.coalesce(F.col(f"`{column}`"), F.lit(""))

    value = label if label is not None else coerce_label(F.col(f"`{roles['label']}`"))
    return df.select(role("title").alias("title"), role("text").alias("text"), value.alias("label"), *keys)


def read_single(spark: SparkSession, path: str) -> DataFrame:
    """One file with a label column."""
    return standard_columns(read_table(spark, path), PurePosixPath(path).name, need_label=True)


def read_paired(spark: SparkSession, fake: str, true: str) -> DataFrame:
    """A FAKE file and a REAL file; the label is given by the file."""
    parts = [
        standard_columns(read_table(spark, p), PurePosixPath(p).name, need_label=False, label=F.lit(v))
        for p, v in ((fake, FAKE), (true, REAL))
    ]
    return union_all(parts)


def read_truth_labels(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 14-column TSV whose six-way truth label collapses to REAL/FAKE."""
    schema = ", ".join(f"{c} string" for c in TRUTH_COLUMNS)
    raw = spark.read.schema(schema).csv(path, sep="\t", header=False, multiLine=True, quote='"', escape='"')
    return raw.select(
        F.lit("").alias("title"),
        F.coalesce(_present(F.col("statement")), F.lit("")).alias("text"),
        F.when(F.col("label").isin(TRUTH_FAKE_LABELS), FAKE).otherwise(REAL).alias("label"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of several tables with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def _headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, ...]]:
    """Column names of each table; only first lines are read, several tables at a time."""
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(lambda p: tuple(_raw(spark, [p]).columns), paths))


def read_news(spark: SparkSession, folder: str) -> DataFrame:
    """All labelled rows of a folder as title, text, label, with an order key.

    Tables with the same header and label are one scan, however many they are. ``file`` (the
    file's path) and ``row_no`` order the rows: rows of a quoted multi-line file are read in order
    by one task, so the generated id rises with the file's lines however files are dealt to tasks.
    """
    layout = find_layout(spark, folder)
    if layout["mode"] == "paired":
        tables = [(layout["fake"], FAKE), (layout["true"], REAL)]
    else:
        tables = [(path, None) for path in layout["files"]]
    scans: dict[tuple, list[str]] = {}
    for (path, label), header in zip(tables, _headers(spark, [path for path, _ in tables])):
        scans.setdefault((header, PurePosixPath(path).suffix.lower(), label), []).append(path)
    order = (F.col("__file").alias("file"), F.col("__row").alias("row_no"))
    keys = (F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    parts = []
    for (header, _, label), paths in scans.items():
        rows = _presented(_raw(spark, paths, list(header)), *keys)
        value = None if label is None else F.lit(label)
        parts.append(standard_columns(rows, PurePosixPath(paths[0]).name, label is None, value, *order))
    return union_all(parts)
