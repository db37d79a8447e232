"""TF-IDF and scaled stylistic features.

A fitted space is small by construction: at most ``max_features`` terms with their
idf, plus the range of nine numeric columns. It is held on the driver and enters
plans as literals, so transforming documents is a narrow step: no join, no shuffle,
and the input columns ride along. Per document the terms are counted by a
vocabulary lookup and all arithmetic is native array expressions.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credlake.config import DEFAULTS, NUMERIC_FEATURES, Settings
from credlake.errors import DataValidationError
from credlake.functions.cleaning import clean_text_tokens
from credlake.functions.text import let


# ---- terms ------------------------------------------------------------------


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams of a token array; empty when there are fewer than n tokens."""
    if n == 1:
        return tokens
    starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    return F.transform(
        starts, lambda t, i: F.concat_ws(" ", t, *[F.get(tokens, i + k) for k in range(1, n)])
    )


def terms(tokens: Column, settings: Settings = DEFAULTS) -> Column:
    """All n-grams of the configured range."""
    low, high = settings.ngram_range
    return let(tokens, lambda t: F.concat(*[ngrams(t, n) for n in range(low, high + 1)]))


def with_terms(df: DataFrame, settings: Settings = DEFAULTS, clean: str = "clean_text") -> DataFrame:
    """Add ``terms``, the n-grams of the cleaned text."""
    tokens = clean_text_tokens(F.coalesce(F.col(clean), F.lit("")), settings.cleaning)
    return df.withColumn("terms", terms(tokens, settings))


def term_statistics(df: DataFrame) -> DataFrame:
    """Corpus count ``tf`` and document frequency ``df`` per term.

    Each document emits its terms once, sorted, and marks the first of equal ones for df, so
    a single aggregation with map-side combining does; no (document, term) shuffle.
    """
    marked = let(
        F.sort_array("terms"),
        lambda s: F.transform(s, lambda t, i: F.struct(t.alias("term"), (~t.eqNullSafe(F.get(s, i - 1))).cast("int").alias("first"))),
    )
    # the outer form keeps the optimizer from computing the terms a second time in a
    # filter on their number
    return (
        df.select(F.inline_outer(marked))
        .filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df"))
    )


def vocabulary(stats: DataFrame, n_docs: int | Column, settings: Settings = DEFAULTS) -> DataFrame:
    """(idx, term, tf, df, idf): frequent terms within the df limits, at most
    ``max_features`` of them by corpus count (ties by term), indexed in term order.

    The limit is a top-k and bounds everything after it.
    """
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    within = (F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * n)
    top = stats.filter(within).orderBy(F.desc("tf"), "term").limit(settings.max_features)
    return top.select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        "term",
        "tf",
        "df",
        smooth_idf(n, F.col("df")).alias("idf"),
    )


def smooth_idf(n: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1"""
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


# ---- numeric block ----------------------------------------------------------


def numeric_ranges(df: DataFrame) -> DataFrame:
    """(feature, min, max) of the numeric columns, in fixed order, from one pass."""
    sides = [F.min(c).alias(f"lo_{c}") for c in NUMERIC_FEATURES]
    sides += [F.max(c).alias(f"hi_{c}") for c in NUMERIC_FEATURES]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max")
            )
            for c in NUMERIC_FEATURES
        ]
    )
    return df.agg(*sides).select(F.inline(rows))


def scale(value: Column, low: float, high: float) -> Column:
    """Min-max scaling clipped to [0, 1]; a constant column gives 0."""
    if high <= low:
        return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value - low)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


# ---- fitted space -----------------------------------------------------------


@dataclass(frozen=True)
class FeatureSpace:
    """Vocabulary (term order), idf and numeric ranges; bounded by ``max_features``."""

    terms: list[str]
    dfs: list[int]
    idf: list[float]
    n_docs: int
    ranges: list[tuple[float, float]]
    settings: Settings = DEFAULTS

    @property
    def names(self) -> list[str]:
        return self.terms + NUMERIC_FEATURES

    @cached_property
    def counter(self) -> CountVectorizerModel:
        """Vocabulary look-up. The terms go to the JVM as one string, because passing
        them one by one takes seconds."""
        jvm = SparkSession.active().sparkContext._jvm
        vocabulary = jvm.org.apache.commons.lang3.StringUtils.split("\n".join(self.terms), "\n")
        model = CountVectorizerModel(jvm.org.apache.spark.ml.feature.CountVectorizerModel(vocabulary))
        return model.setInputCol("terms").setOutputCol("__counts")

    @property
    def size(self) -> int:
        return len(self.terms) + len(NUMERIC_FEATURES)


def fit_feature_space(train: DataFrame, settings: Settings = DEFAULTS) -> FeatureSpace:
    """Fit on the training rows only (they carry clean_text and numeric columns).

    Brings only the vocabulary and eighteen numbers to the driver.
    """
    n_docs = train.count()
    stats = term_statistics(with_terms(train, settings).select("terms"))
    rows = vocabulary(stats, n_docs, settings).orderBy("idx").collect()
    if not rows:
        raise DataValidationError("No term is left after document-frequency pruning.")
    ranges = {r["feature"]: (r["min"], r["max"]) for r in numeric_ranges(train).collect()}
    return FeatureSpace(
        terms=[r["term"] for r in rows],
        dfs=[r["df"] for r in rows],
        idf=[r["idf"] for r in rows],
        n_docs=n_docs,
        ranges=[ranges[c] for c in NUMERIC_FEATURES],
        settings=settings,
    )


def double_array(values: list[float]) -> Column:
    """A literal array<double>: one string literal, folded once by the optimizer."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def string_array(values: list[str]) -> Column:
    """A literal array<string> (terms hold only letters, digits and blanks)."""
    return F.split(F.lit("\n".join(values)), "\n")


def _weighed(df: DataFrame, space: FeatureSpace) -> DataFrame:
    """Add the counted ``terms`` as ``__sparse`` and their TF-IDF weights at unit length as ``__unit``.

    The length is bound once; a column of its own would be copied into the division and so
    summed again for every term of the row.
    """
    idf = double_array(space.idf)

    def weigh(i: Column, tf: Column) -> Column:
        return (F.log(tf) + 1.0 if space.settings.sublinear_tf else tf) * F.get(idf, i)

    counted = space.counter.transform(df).withColumn("__sparse", F.unwrap_udt("__counts"))
    weighted = counted.withColumn("__w", F.zip_with("__sparse.indices", "__sparse.values", weigh))
    squares = F.aggregate("__w", F.lit(0.0), lambda acc, w: acc + w * w)
    return weighted.withColumn("__unit", let(F.sqrt(squares), lambda norm: F.transform("__w", lambda w: w / norm))).drop("__w")


def transform(df: DataFrame, space: FeatureSpace) -> DataFrame:
    """Add ``idx`` (array<int>) and ``val`` (array<double>): the sparse TF-IDF row with
    unit length, followed by the scaled numeric features that are not zero."""
    numeric = F.array(
        *[
            F.struct(
                F.lit(len(space.terms) + k).alias("i"),
                scale(F.col(name), *space.ranges[k]).alias("v"),
            )
            for k, name in enumerate(NUMERIC_FEATURES)
        ]
    )
    normed = _weighed(with_terms(df, space.settings), space).withColumn(
        "__num", F.filter(numeric, lambda s: s["v"] != 0.0)
    )
    return normed.withColumns(
        {
            "idx": F.concat("__sparse.indices", F.col("__num.i")),
            "val": F.concat("__unit", F.col("__num.v")),
        }
    ).drop("terms", "__counts", "__sparse", "__unit", "__num")


def to_long(df: DataFrame, key: list[str], space: FeatureSpace | None = None) -> DataFrame:
    """One row per document and active feature: (key, idx, value[, feature])."""
    pairs = df.select(*key, F.inline_outer(F.arrays_zip(F.col("idx"), F.col("val"))))
    pairs = pairs.filter(F.col("idx").isNotNull()).withColumnRenamed("val", "value")
    if space is None:
        return pairs
    return pairs.withColumn("feature", F.get(string_array(space.names), F.col("idx")))


def with_vector(df: DataFrame, space: FeatureSpace, column: str = "features") -> DataFrame:
    """Add an ML sparse vector built from ``idx`` and ``val``.

    There is no built-in from sparse arrays to a vector, but the JSON reader knows the
    vector type, so the conversion stays in the JVM.
    """
    layout = F.struct(
        F.struct(
            F.lit(0).alias("type"),
            F.lit(space.size).alias("size"),
            F.col("idx").alias("indices"),
            F.col("val").alias("values"),
        ).alias("v")
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return df.withColumn(column, F.from_json(F.to_json(layout), schema)["v"])


def feature_names(space_vocab: DataFrame) -> DataFrame:
    """(position, feature): vocabulary terms in index order, then the numeric names."""
    n_terms = space_vocab.agg(F.count(F.lit(1)).alias("n")).scalar()
    numeric = (
        space_vocab.sparkSession.range(1)
        .select(F.posexplode(F.array(*[F.lit(n) for n in NUMERIC_FEATURES])).alias("p", "feature"))
        .select((F.col("p") + n_terms).cast("long").alias("position"), "feature")
    )
    terms_part = space_vocab.select(
        F.col("idx").cast("long").alias("position"), F.col("term").alias("feature")
    )
    return terms_part.unionByName(numeric)


def tfidf_long(df: DataFrame, vocab: DataFrame, key: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """(key, term, weight) of documents with ``terms``, for vocabularies kept as tables.

    The vocabulary comes to the driver, its size being bounded by ``max_features``. Terms are
    counted, weighed and normalised inside the row and taken apart last: nothing is shuffled.
    """
    rows = vocab.orderBy("idx").select("term", "df", "idf").collect()
    if not rows:
        return df.select(*key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).where("false")
    space = FeatureSpace([r["term"] for r in rows], [r["df"] for r in rows], [r["idf"] for r in rows], 0, [], settings)
    weighed = _weighed(df.select(*key, "terms"), space)
    pairs = weighed.select(*key, F.inline(F.arrays_zip(F.col("__sparse.indices").alias("i"), F.col("__unit").alias("weight"))))
    return pairs.select(*key, F.get(string_array(space.terms), F.col("i")).alias("term"), "weight")
