"""Table store, report sinks and model tables."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.config import NUMERIC_FEATURES, CleaningConfig, Settings
from credlake.errors import ModelNotFoundError
from credlake.operators.linear import LinearModel
from credlake.operators.vectorize import FeatureSpace
from credlake.schemas import TABLES


def table_path(root: str, name: str) -> str:
    return f"{root}/{name}"


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Append rows to a stored table, by name, with the table's column types."""
    fields = [f.strip().split(" ") for f in TABLES[name].split(",")]
    have = set(df.columns)
    rows = df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields]
    )
    rows.write.mode("append").parquet(table_path(root, name))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(table_path(root, name))


def read_result(spark: SparkSession, root: str, request_id: str) -> dict[str, DataFrame]:
    """Rows of one request from every stored table; the filter is pushed to parquet."""
    return {
        name: read_table(spark, root, name).filter(F.col("request_id") == request_id)
        for name in TABLES
    }


# ---- reports ----------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    """CSV report with header; quotes are doubled, as spreadsheet readers expect."""
    df.write.mode("overwrite").csv(
        path,
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json(df: DataFrame, path: str) -> None:
    """Metrics or metadata rows as JSON lines (null fields kept)."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# ---- models -----------------------------------------------------------------


def save_model(spark: SparkSession, path: str, space: FeatureSpace, model: LinearModel) -> None:
    """Write vocabulary, ranges, weights and parameters as tables. All are bounded by
    the vocabulary limit, so they are created from driver values."""
    vocab = list(zip(range(len(space.terms)), space.terms, space.dfs, space.idf))
    ranges = [(i, n, float(lo), float(hi)) for i, (n, (lo, hi)) in enumerate(zip(NUMERIC_FEATURES, space.ranges))]
    weights = [(i, n, float(w)) for i, (n, w) in enumerate(zip(space.names, model.weights))]
    settings = {k: getattr(space.settings, k) for k in ("sublinear_tf", "ngram_range", "max_input_chars")}
    settings["cleaning"] = vars(space.settings.cleaning)
    meta = [(model.name, float(model.bias), space.n_docs, json.dumps(model.params), json.dumps(settings))]
    tables = {
        "vocab": (vocab, "idx int, term string, df long, idf double"),
        "scaler": (ranges, "idx int, feature string, min double, max double"),
        "weights": (weights, "idx int, feature string, weight double"),
        "model": (meta, "name string, bias double, n_docs long, params string, settings string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[FeatureSpace, LinearModel]:
    """Read a saved model; a missing table is an error that says what to do."""

    def rows(name: str) -> list:
        location = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
            raise ModelNotFoundError(f"Could not find the trained {name} at {path}. Train and save a model first.")
        df = spark.read.parquet(f"{path}/{name}")
        return (df.orderBy("idx") if "idx" in df.columns else df).collect()

    meta = rows("model")[0]
    stored = json.loads(meta["settings"])
    settings = Settings(
        sublinear_tf=stored["sublinear_tf"],
        ngram_range=tuple(stored["ngram_range"]),
        max_input_chars=stored["max_input_chars"],
        cleaning=CleaningConfig(**stored["cleaning"]),
    )
    vocab = rows("vocab")
    space = FeatureSpace(
        terms=[r["term"] for r in vocab],
        dfs=[r["df"] for r in vocab],
        idf=[r["idf"] for r in vocab],
        n_docs=meta["n_docs"],
        ranges=[(r["min"], r["max"]) for r in rows("scaler")],
        settings=settings,
    )
    weights = [r["weight"] for r in rows("weights")]
    return space, LinearModel(meta["name"], weights, meta["bias"], json.loads(meta["params"]))
