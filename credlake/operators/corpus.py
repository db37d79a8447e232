"""Labelled article corpus: clean, de-duplicate, audit, split, fold, sample."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlake.config import DEFAULTS, FAKE, Settings
from credlake.errors import DataValidationError
from credlake.functions import text as tx
from credlake.functions.cleaning import clean_tokens, normalize_text, normalize_unicode
from credlake.functions.style import with_style
from credlake.operators.common import first_rows


def with_content(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Fill missing title and text and add their combination as ``content``."""
    return df.na.fill("", [title, text]).withColumn(
        "content", tx.combine_title_text(F.col(title), F.col(text))
    )


def labelled(df: DataFrame) -> DataFrame:
    """Rows with a label, as an integer."""
    return df.filter(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("int"))


def with_text_content(df: DataFrame) -> DataFrame:
    """Rows whose content is not blank."""
    return df.filter(~tx.is_blank(F.col("content")))


def deduplicate(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per exact content, the first by ``order``.

    ``order`` names the columns that identify a row. Grouped on a 32-byte digest with ids alone;
    texts stay out of the aggregation and join back by id.
    """
    return first_rows(df, [tx.content_digest(F.col("content"))], order)


def clean_dataset(df: DataFrame, order: list[str], check: bool = False) -> DataFrame:
    """Labelled, non-blank, de-duplicated rows with ``content``.

    ``check`` runs one small job that raises when nothing is left.
    """
    out = deduplicate(with_text_content(with_content(labelled(df))), order)
    if check and out.isEmpty():
        raise DataValidationError(
            "Dataset is empty after cleaning: no row has both readable text and a known label."
        )
    return out


def cleaning_audit(df: DataFrame) -> DataFrame:
    """One row: rows read, dropped for each reason, and left. One pass."""
    staged = with_content(df).select(
        F.col("label").isNotNull().alias("has_label"),
        tx.is_blank(F.col("content")).alias("blank"),
        tx.content_digest(F.col("content")).alias("digest"),
    )
    kept = F.col("has_label") & ~F.col("blank")
    counts = staged.agg(
        F.count(F.lit(1)).alias("n_start"),
        F.count_if(~F.col("has_label")).alias("dropped_missing_label"),
        F.count_if(F.col("has_label") & F.col("blank")).alias("dropped_empty"),
        F.count_if(kept).alias("__kept"),
        F.count_distinct(F.when(kept, F.col("digest"))).alias("n_final"),
    )
    return counts.select(
        "n_start",
        "dropped_missing_label",
        "dropped_empty",
        (F.col("__kept") - F.col("n_final")).alias("dropped_duplicates"),
        "n_final",
    )


def with_clean_text(df: DataFrame, settings: Settings = DEFAULTS, content: str = "content") -> DataFrame:
    """Add ``clean_text``. The Unicode step is its own projection, so its result is
    computed once although later steps refer to it several times."""
    cfg = settings.cleaning
    return (
        df.withColumn("__u", normalize_unicode(F.col(content)))
        .withColumn("__n", normalize_text(F.col("__u"), cfg))
        .withColumn("clean_text", F.array_join(clean_tokens(F.col("__n"), cfg), " "))
        .drop("__u", "__n")
    )


def add_engineered_columns(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``clean_text`` and the stylistic features, both from ``content``."""
    return with_style(with_clean_text(df, settings))


def empty_after_cleaning(df: DataFrame) -> DataFrame:
    """One row: how many kept rows have no term left after cleaning."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("clean_text") == "").alias("n_empty_clean"),
    )


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows per decoded label."""
    return df.groupBy(tx.decode_label(F.col("label")).alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def length_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of content length per class.

    The range of a class is one row per label, so it is safe to broadcast.
    """
    sized = df.select("label", F.length("content").alias("n_chars"))
    ranges = sized.groupBy("label").agg(
        F.min("n_chars").cast("double").alias("low"), F.max("n_chars").cast("double").alias("high")
    )
    width = (F.col("high") - F.col("low")) / bins
    index = F.when(width > 0, F.floor((F.col("n_chars") - F.col("low")) / width)).otherwise(0)
    binned = sized.join(ranges, "label").select(
        tx.decode_label(F.col("label")).alias("label"),
        (F.least(index, F.lit(bins - 1)) + 1).cast("int").alias("bin"),
    )
    return binned.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- split, folds, sample ---------------------------------------------------


def with_split(df: DataFrame, key: str | Column = "content", settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``split`` by hash of the key: repeatable, no shuffle, every copy of a
    content lands in the same split, and class shares hold in expectation."""
    key = F.col(key) if isinstance(key, str) else key
    bucket = tx.hash_bucket(key, settings.seed)
    test = round(settings.test_size * 10000)
    validation = test + round(settings.validation_size * 10000)
    name = F.when(bucket < test, "test").when(bucket < validation, "validation").otherwise("train")
    return df.withColumn("split", name)


def with_exact_split(
    df: DataFrame, key: str = "content", order: str = "doc_id", settings: Settings = DEFAULTS
) -> DataFrame:
    """Add ``split`` with exact quotas per label.

    The rank of a row inside its label is the number of rows in lower hash buckets
    (a table of at most labels x 10 000 rows) plus its rank inside its own bucket, so
    no task ever sorts a whole class.
    """
    keyed = df.withColumn("__h", tx.hash_number(F.col(key), settings.seed)).withColumn(
        "__b", F.pmod(F.col("__h"), F.lit(10000)).cast("int")
    )
    sizes = keyed.groupBy("label", "__b").agg(F.count(F.lit(1)).alias("__n"))
    by_label = Window.partitionBy("label")
    before = by_label.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "label",
        "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(by_label).alias("__total"),
    )
    inside = F.row_number().over(Window.partitionBy("label", "__b").orderBy("__h", order))
    n_test = F.ceil(F.col("__total") * settings.test_size)
    n_validation = F.ceil(F.col("__total") * settings.validation_size)
    rank = F.col("__before") + F.col("__inside")
    name = (
        F.when(rank <= n_test, "test")
        .when(rank <= n_test + n_validation, "validation")
        .otherwise("train")
    )
    return (
        keyed.withColumn("__inside", inside)
        .join(offsets, ["label", "__b"])
        .withColumn("split", name)
        .select(*df.columns, "split")
    )


def with_fold(df: DataFrame, key: str | Column = "content", settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``fold`` 0..k-1 by hash of the key (a seed of its own, so folds are
    independent of the split)."""
    key = F.col(key) if isinstance(key, str) else key
    return df.withColumn("fold", tx.hash_bucket(key, f"fold{settings.seed}", settings.cv_folds))


def split_summary(df: DataFrame) -> DataFrame:
    """Rows and share of FAKE per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(F.when(F.col("label") == FAKE, 100.0).otherwise(0.0)), 6).alias("pct_fake"),
    )


def split_overlap(df: DataFrame) -> DataFrame:
    """One row: contents found in more than one split (must be 0)."""
    per_content = df.groupBy(tx.content_digest(F.col("content"))).agg(
        F.min("split").alias("low"), F.max("split").alias("high")
    )
    return per_content.agg(F.count_if(F.col("low") != F.col("high")).alias("n_overlap"))


def sample_rows(df: DataFrame, n: int, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Repeatable sample of n rows: the n smallest key hashes (a top-k, no full sort)."""
    return df.orderBy(tx.hash_number(F.col(key), f"sample{settings.seed}"), key).limit(n)
