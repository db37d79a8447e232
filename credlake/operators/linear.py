"""Linear classifiers over the feature space: fit, score, explain.

Every model reduces to one weight per feature and a bias, at most
``max_features + 9`` numbers, so a fitted model is a driver-side value that enters
plans as a literal.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlake.config import DEFAULTS, Settings
from credlake.functions.text import confidence_level, decode_label
from credlake.operators import shards
from credlake.operators.shards import Config, Shards
from credlake.operators.vectorize import FeatureSpace, double_array, string_array

# Fixed value: the note shown with every explained prediction.
DISCLAIMER = (
    "This is a machine-learning text classifier trained to recognize linguistic "
    "patterns associated with fake or real news in its training data. It is NOT "
    "an authoritative fact-checker and does not verify claims against real-world "
    "evidence. Always cross-check important claims with trusted, independent "
    "sources."
)

# Models in the order that decides ties; the flag says whether scores are probabilities.
MODEL_ORDER = ["LogisticRegression", "MultinomialNB", "LinearSVC", "PassiveAggressiveClassifier"]
IS_PROBABILITY = {
    "LogisticRegression": True,
    "MultinomialNB": True,
    "LinearSVC": False,
    "PassiveAggressiveClassifier": False,
}


@dataclass(frozen=True)
class LinearModel:
    name: str
    weights: list[float]
    bias: float
    params: dict = field(default_factory=dict)

    @property
    def is_probability(self) -> bool:
        return IS_PROBABILITY[self.name]


# ---- fitting ----------------------------------------------------------------


def class_feature_sums(train: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of each feature per class (and group): all that naive Bayes needs."""
    return (
        train.select(*(by or []), "label", F.inline_outer(F.arrays_zip(F.col("idx"), F.col("val"))))
        .filter(F.col("idx").isNotNull())
        .groupBy(*(by or []), "label", "idx")
        .agg(F.sum("val").alias("total"))
    )


def nb_from_sums(sums: np.ndarray, counts: np.ndarray, alpha: float) -> LinearModel:
    """Naive Bayes weights: difference of smoothed log feature shares, prior log odds."""
    smoothed = sums + alpha
    log_share = np.log(smoothed) - np.log(smoothed.sum(axis=1, keepdims=True))
    weights = log_share[1] - log_share[0]
    bias = float(np.log(counts[1]) - np.log(counts[0]))
    return LinearModel("MultinomialNB", weights.tolist(), bias, {"alpha": alpha})


def _class_tables(train: DataFrame, space: FeatureSpace, by: str | None = None):
    """Feature sums and row counts per group and class as small dense arrays: at most
    groups x 2 x features numbers reach the driver."""
    group = [by] if by else []
    totals = class_feature_sums(train, group).toPandas()
    rows = train.groupBy(*group, "label").count().toPandas()
    sums, counts = {}, {}
    for key in rows[by].unique() if by else [None]:
        mine = totals if by is None else totals[totals[by] == key]
        own = rows if by is None else rows[rows[by] == key]
        sums[key] = np.zeros((2, space.size))
        sums[key][mine["label"], mine["idx"]] = mine["total"]
        counts[key] = np.zeros(2)
        counts[key][own["label"]] = own["count"]
    return sums, counts


def fit_naive_bayes(train: DataFrame, space: FeatureSpace, alpha: float = 1.0) -> LinearModel:
    """Multinomial naive Bayes in closed form from one aggregate."""
    sums, counts = _class_tables(train, space)
    return nb_from_sums(sums[None], counts[None], alpha)


def fit_naive_bayes_folds(
    train: DataFrame, space: FeatureSpace, alphas: list[float]
) -> dict[tuple[int, float], LinearModel]:
    """All fold x alpha models from one aggregate: a fold's training sums are the
    totals minus that fold's own sums."""
    sums, counts = _class_tables(train, space, "fold")
    total, n = sum(sums.values()), sum(counts.values())
    return {
        (fold, alpha): nb_from_sums(total - sums[fold], n - counts[fold], alpha)
        for fold in sums
        for alpha in alphas
    }


def _model(name: str, weights: np.ndarray, params: dict) -> LinearModel:
    return LinearModel(name, weights[:-1].tolist(), float(weights[-1]), params)


def fit_logistic_regression(train: DataFrame, space: FeatureSpace, C: float = 1.0, class_weight: str | None = None, max_iter: int = 2000, packed: Shards | None = None, **_ignored) -> LinearModel:
    """L2 logistic regression: C times the summed loss plus half the squared weights, constant not penalised."""
    found = shards.fit_smooth(packed or shards.sharded(train, space.size), "logistic", [Config(C, class_weight)], max_iter)
    return _model("LogisticRegression", found[0], {"C": C, "class_weight": class_weight})


def fit_linear_svc(train: DataFrame, space: FeatureSpace, C: float = 1.0, class_weight: str | None = None, max_iter: int = 5000, packed: Shards | None = None) -> LinearModel:
    """Linear support vector classifier: squared hinge loss, the constant penalised like a weight."""
    found = shards.fit_smooth(packed or shards.sharded(train, space.size), "squared_hinge", [Config(C, class_weight)], max_iter)
    return _model("LinearSVC", found[0], {"C": C, "class_weight": class_weight})


def fit_smooth_folds(name: str, train: DataFrame, space: FeatureSpace, sets: list[dict], folds: int, packed: Shards | None = None) -> dict[tuple[int, int], LinearModel]:
    """Models by (fold, position of the parameter set), fitted without the fold, all in the same passes."""
    loss = "logistic" if name == "LogisticRegression" else "squared_hinge"
    keys = [(fold, n) for n in range(len(sets)) for fold in range(folds)]
    configs = [Config(sets[n]["C"], sets[n].get("class_weight"), fold) for fold, n in keys]
    found = shards.fit_smooth(packed or shards.sharded(train, space.size), loss, configs)
    return {key: _model(name, weights, sets[key[1]]) for key, weights in zip(keys, found)}


def fit_passive_aggressive(
    train: DataFrame, space: FeatureSpace, C: float = 1.0, max_iter: int = 1000, **options
) -> LinearModel:
    """One passive-aggressive model on all training rows."""
    return fit_passive_aggressive_many(train, space, [(C, None)], max_iter, **options)[0]


def fit_passive_aggressive_many(
    train: DataFrame,
    space: FeatureSpace,
    configs: list[tuple[float, int | None]],
    max_iter: int = 1000,
    tol: float = 1e-3,
    patience: int = 5,
    seed: int = DEFAULTS.seed,
    packed: Shards | None = None,
) -> list[LinearModel]:
    """Passive-aggressive (PA-I) models, several at once; a config is (C, fold left out or none)."""
    asked = [Config(c, None, -1 if fold is None else fold) for c, fold in configs]
    found = shards.fit_passive_aggressive(packed or shards.sharded(train, space.size), asked, max_iter, tol, patience, seed)
    return [_model("PassiveAggressiveClassifier", w, {"C": c, "max_iter": max_iter}) for (c, _), w in zip(configs, found)]


# ---- scoring ----------------------------------------------------------------


def margin(model: LinearModel) -> Column:
    """Bias plus the weighted sum of a row's features."""
    weights = double_array(model.weights)
    products = F.zip_with("idx", "val", lambda i, v: v * F.get(weights, i))
    return F.aggregate(products, F.lit(float(model.bias)), lambda acc, x: acc + x)


def sigmoid(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def with_score(df: DataFrame, model: LinearModel) -> DataFrame:
    """Add ``score`` (that of FAKE), ``prediction`` and ``confidence`` of the prediction."""
    scored = df.withColumn("score", sigmoid(margin(model)))
    return with_prediction(scored)


def with_prediction(df: DataFrame) -> DataFrame:
    """Prediction (score of at least one half) and confidence from ``score``."""
    return df.withColumn("prediction", (F.col("score") >= 0.5).cast("int")).withColumn(
        "confidence",
        F.when(F.col("prediction") == 1, F.col("score")).otherwise(1.0 - F.col("score")),
    )


def with_decisions(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Decode and bucket: the three output columns, null for rows that are not valid."""
    valid = F.col("__valid")
    level = confidence_level(F.col("confidence"), settings.high_confidence, settings.medium_confidence)
    return df.withColumns(
        {
            "prediction": F.when(valid, decode_label(F.col("prediction"))),
            "confidence_level": F.when(valid, level).otherwise("Unknown"),
            "confidence": F.when(valid & ~F.isnan("confidence"), F.round("confidence", 4)),
        }
    )


def fold_scores(df: DataFrame, models: dict[tuple[int, int], LinearModel], size: int) -> DataFrame:
    """Score each row with the models of its own fold, in one pass.

    ``models`` maps (fold, key) to a model; the weights of one key's folds form one
    literal, addressed by fold. Gives (key, fold, label, prediction).
    """
    folds = sorted({fold for fold, _ in models})
    keys = sorted({key for _, key in models})
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")).cast("int") - 1

    def score(key: int) -> Column:
        flat = double_array([w for fold in folds for w in models[fold, key].weights])
        biases = double_array([models[fold, key].bias for fold in folds])
        products = F.zip_with("idx", "val", lambda i, v: v * F.get(flat, F.col("__at") + i))
        return sigmoid(F.aggregate(products, F.get(biases, F.col("__place")), lambda acc, x: acc + x))

    placed = df.withColumn("__place", place).withColumn("__at", F.col("__place") * size)
    scored = F.array(*[F.struct(F.lit(key).alias("key"), score(key).alias("score")) for key in keys])
    rows = with_prediction(placed.select("fold", "label", F.inline(scored)))
    return rows.select("key", "fold", "label", "prediction")


def stacked_scores(df: DataFrame, models: list[LinearModel]) -> DataFrame:
    """One row per input row and model, so that all models are measured in one pass."""
    scored = F.array(
        *[F.struct(F.lit(m.name).alias("model"), sigmoid(margin(m)).alias("score")) for m in models]
    )
    others = [c for c in df.columns if c not in ("idx", "val", "features")]
    return with_prediction(df.select(*others, F.inline(scored)))


# ---- explanations -----------------------------------------------------------


def weight_rows(df_session, model: LinearModel, space: FeatureSpace) -> DataFrame:
    """The model as a table (model, idx, feature, weight)."""
    names, weights = string_array(space.names), double_array(model.weights)
    return df_session.range(1).select(
        F.lit(model.name).alias("model"),
        F.inline(
            F.transform(
                F.arrays_zip(names.alias("feature"), weights.alias("weight")),
                lambda s, i: F.struct(i.alias("idx"), s["feature"].alias("feature"), s["weight"].alias("weight")),
            )
        ),
    )


def global_top_features(weights: DataFrame, n: int = 15) -> DataFrame:
    """The n strongest FAKE and the n strongest REAL features (two top-k reads)."""
    fake = weights.filter(F.col("weight") > 0).orderBy(F.desc("weight"), "feature").limit(n)
    real = weights.filter(F.col("weight") < 0).orderBy("weight", "feature").limit(n)
    return fake.withColumn("indicator", F.lit("FAKE")).unionByName(
        real.withColumn("indicator", F.lit("REAL"))
    ).select("indicator", "feature", F.round("weight", 4).alias("weight"))


def top_features(model: LinearModel, space: FeatureSpace, n: int = 10) -> Column:
    """Array of a row's n strongest active features by |weight x value|, computed
    inside the row; equal strengths are ordered by name."""
    weights, names = double_array(model.weights), string_array(space.names)

    def entry(i: Column, v: Column) -> Column:
        contribution = v * F.get(weights, i)
        return F.struct(
            (-F.round(F.abs(contribution), 10)).alias("rank"),
            F.get(names, i).alias("feature"),
            contribution.alias("contribution"),
        )

    active = F.filter(F.arrays_zip(F.col("idx"), F.col("val")), lambda s: s["val"] != 0.0)
    ranked = F.array_sort(F.transform(active, lambda s: entry(s["idx"], s["val"])))
    return F.transform(
        F.slice(ranked, 1, n),
        lambda s: F.struct(
            s["feature"].alias("feature"),
            F.round(s["contribution"], 4).alias("weight"),
            F.when(s["contribution"] > 0, "FAKE").otherwise("REAL").alias("direction"),
        ),
    )


def contributions(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(…, feature, contribution, direction) for features kept as tables."""
    value = F.col("value") * F.col("weight")
    return (
        pairs.filter(F.col("value") != 0.0)
        .join(weights.select("feature", "weight"), "feature")
        .withColumns(
            {
                "contribution": value,
                "direction": F.when(value > 0, "FAKE").otherwise("REAL"),
            }
        )
    )


def local_top_contributions(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Top n contribution rows per document, for contributions kept as a table."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("contribution"), 10)), "feature")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
