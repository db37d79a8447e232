"""Train, tune, select and test the classifiers."""
from __future__ import annotations

import platform
import random
from dataclasses import dataclass
from itertools import product

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.config import DEFAULTS, NUMERIC_FEATURES, Settings
from credlake.functions.text import decode_label
from credlake.operators import corpus, linear, metrics, shards, vectorize
from credlake.operators.common import materialize
from credlake.operators.linear import MODEL_ORDER, LinearModel
from credlake.operators.shards import Shards
from credlake.operators.vectorize import FeatureSpace

# Parameter grids. The solver choice of logistic regression has no
# meaning here (one optimizer), so both solvers give the same fit and are not repeated.
QUICK_GRIDS = {
    "LogisticRegression": {"C": [0.1, 1.0], "class_weight": [None, "balanced"]},
    "MultinomialNB": {"alpha": [0.1, 1.0]},
    "LinearSVC": {"C": [0.1, 1.0]},
    "PassiveAggressiveClassifier": {"C": [0.1, 1.0]},
}
FULL_GRIDS = {
    "LogisticRegression": {"C": [0.01, 0.1, 1.0, 10.0], "class_weight": [None, "balanced"]},
    "MultinomialNB": {"alpha": [0.01, 0.1, 0.5, 1.0]},
    "LinearSVC": {"C": [0.01, 0.1, 1.0, 10.0], "class_weight": [None, "balanced"]},
    "PassiveAggressiveClassifier": {"C": [0.01, 0.1, 1.0, 10.0], "max_iter": [1000, 2000]},
}


def parameter_sets(grid: dict, settings: Settings = DEFAULTS) -> list[dict]:
    """All combinations of a grid, or a repeatable sample of them for random search."""
    names = list(grid)
    sets = [dict(zip(names, values)) for values in product(*grid.values())]
    if settings.search_type == "random":
        n = min(settings.random_search_iterations, len(sets))
        return random.Random(settings.seed).sample(sets, n)
    return sets


@dataclass
class TrainingResult:
    best_model: LinearModel
    space: FeatureSpace
    models: list[LinearModel]
    validation_metrics: DataFrame
    test_metrics: DataFrame
    test_predictions: DataFrame
    metadata: DataFrame


def prepare(df: DataFrame, order: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Clean, engineer, split and fold; written once because fitting reads it often."""
    ready = corpus.add_engineered_columns(corpus.clean_dataset(df, order, check=True), settings)
    return materialize(corpus.with_fold(corpus.with_split(ready, settings=settings), settings=settings), "corpus")


def featurize(prepared: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, FeatureSpace]:
    """Feature rows of all splits in a space fitted on the training split only."""
    space = vectorize.fit_feature_space(prepared.filter(F.col("split") == "train"), settings)
    rows = vectorize.with_vector(vectorize.transform(prepared, space), space)
    return materialize(rows.drop(*NUMERIC_FEATURES, "clean_text"), "features"), space


def _best_by_folds(train: DataFrame, models: dict, size: int) -> int:
    """Position of the parameter set with the best mean F1 over folds (the first on
    ties), from one pass over the training rows."""
    scored = linear.fold_scores(train, models, size)
    per_fold = metrics.classification_scores(scored, ["key", "fold"])
    means = per_fold.groupBy("key").agg(F.avg("f1").alias("f1"))
    return means.orderBy(F.desc("f1"), "key").first()["key"]


def _tune_smooth(name: str, train: DataFrame, space: FeatureSpace, sets: list[dict], settings: Settings, packed: Shards | None = None) -> dict:
    """The whole grid of a smooth loss, every (set, fold) fitted in the same passes."""
    models = linear.fit_smooth_folds(name, train, space, sets, settings.cv_folds, packed)
    return sets[_best_by_folds(train, models, space.size)]


def _tune_naive_bayes(train: DataFrame, space: FeatureSpace, sets: list[dict]) -> dict:
    fitted = linear.fit_naive_bayes_folds(train, space, [s["alpha"] for s in sets])
    folds = {fold for fold, _ in fitted}
    models = {(f, n): fitted[f, s["alpha"]] for f in folds for n, s in enumerate(sets)}
    return sets[_best_by_folds(train, models, space.size)]


def _tune_passive_aggressive(train: DataFrame, space: FeatureSpace, sets: list[dict], settings: Settings, packed: Shards | None = None) -> dict:
    """The whole grid is trained together; sets that differ only in an iteration limit
    beyond the epochs run are the same fit, and the first of them stands for all."""
    steps = list(dict.fromkeys(s["C"] for s in sets))
    configs = [(c, fold) for c in steps for fold in range(settings.cv_folds)]
    fitted = linear.fit_passive_aggressive_many(train, space, configs, packed=packed)
    models = {(fold, steps.index(c)): model for (c, fold), model in zip(configs, fitted)}
    best = steps[_best_by_folds(train, models, space.size)]
    return next(s for s in sets if s["C"] == best)


def tune(name: str, train: DataFrame, space: FeatureSpace, sets: list[dict], settings: Settings = DEFAULTS, packed: Shards | None = None) -> dict:
    """Parameters with the best cross-validated F1; the first set on ties."""
    if len(sets) == 1:
        return sets[0]
    if name == "MultinomialNB":
        return _tune_naive_bayes(train, space, sets)
    if name == "PassiveAggressiveClassifier":
        return _tune_passive_aggressive(train, space, sets, settings, packed)
    return _tune_smooth(name, train, space, sets, settings, packed)


def fit(name: str, train: DataFrame, space: FeatureSpace, params: dict, packed: Shards | None = None) -> LinearModel:
    """Fit one model on the training rows; ``packed`` holds the same rows, for models that are fitted over shards."""
    if name == "MultinomialNB":
        return linear.fit_naive_bayes(train, space, **params)
    if name == "PassiveAggressiveClassifier":
        return linear.fit_passive_aggressive(train, space, packed=packed, **params)
    make = linear.fit_logistic_regression if name == "LogisticRegression" else linear.fit_linear_svc
    return make(train, space, packed=packed, **params)


def train_models(
    features: DataFrame,
    space: FeatureSpace,
    settings: Settings = DEFAULTS,
    quick: bool = False,
    tuning: bool | None = None,
) -> list[LinearModel]:
    """All four models, tuned on the training split when asked, refit on all of it. Its rows are dealt to shards once."""
    tuning = settings.enable_tuning if tuning is None else tuning
    train = features.filter(F.col("split") == "train")
    packed = shards.sharded(train, space.size)
    models = []
    for name in MODEL_ORDER:
        params: dict = {}
        if tuning:
            grid = (QUICK_GRIDS if quick else FULL_GRIDS)[name]
            params = tune(name, train, space, parameter_sets(grid, settings), settings, packed)
        models.append(fit(name, train, space, params, packed))
    return models


def run_training(
    df: DataFrame,
    order: list[str],
    settings: Settings = DEFAULTS,
    quick: bool = False,
    tuning: bool | None = None,
) -> TrainingResult:
    """Corpus to selected model: fit on train, pick on validation, report on test once."""
    prepared = prepare(df, order, settings)
    features, space = featurize(prepared, settings)
    models = train_models(features, space, settings, quick, tuning)

    validation = linear.stacked_scores(features.filter(F.col("split") == "validation"), models)
    validation_metrics = materialize(metrics.evaluation(validation, ["model"]), "validation-metrics")
    picked = metrics.best_model(validation_metrics, MODEL_ORDER).first()["best_model"]
    best = next(m for m in models if m.name == picked)

    test = linear.stacked_scores(features.filter(F.col("split") == "test"), [best])
    test_metrics = materialize(metrics.evaluation(test, ["model"]), "test-metrics")
    return TrainingResult(
        best_model=best,
        space=space,
        models=models,
        validation_metrics=validation_metrics,
        test_metrics=test_metrics,
        test_predictions=test,
        metadata=model_metadata(prepared, space, best, validation_metrics, test_metrics),
    )


def model_metadata(
    prepared: DataFrame,
    space: FeatureSpace,
    model: LinearModel,
    validation_metrics: DataFrame,
    test_metrics: DataFrame,
) -> DataFrame:
    """One row describing a training run."""
    spark: SparkSession = prepared.sparkSession
    settings = space.settings
    is_split = {s: F.col("split") == s for s in ("train", "validation", "test")}
    data = prepared.agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count_if(test).alias(f"n_{name}") for name, test in is_split.items()],
        F.count_if(decode_label(F.col("label")) == "REAL").alias("n_real"),
        F.count_if(decode_label(F.col("label")) == "FAKE").alias("n_fake"),
    ).first()

    def scores(df: DataFrame) -> list:
        row = df.filter(F.col("model") == model.name).first()
        names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
        pairs = [x for n in names for x in (F.lit(n), F.lit(None if row is None else row[n]).cast("double"))]
        return F.create_map(*pairs)

    counts = data.asDict()
    real, fake = counts.pop("n_real"), counts.pop("n_fake")
    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__}
    params = {k: str(v) for k, v in model.params.items()}

    def text_map(values: dict):
        if not values:
            return F.lit(None).cast("map<string,string>")
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    return spark.range(1).select(
        F.lit(model.name).alias("model_name"),
        F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss").alias("model_version"),
        F.current_timestamp().alias("training_date"),
        text_map(params).alias("best_hyperparameters"),
        F.struct(
            *[F.lit(v).alias(k) for k, v in counts.items()],
            F.create_map(F.lit("REAL"), F.lit(real), F.lit("FAKE"), F.lit(fake)).alias("class_distribution"),
        ).alias("dataset_info"),
        F.struct(
            F.array(*[F.lit(n) for n in settings.ngram_range]).alias("ngram_range"),
            F.lit(settings.max_features).alias("max_features"),
            F.lit(settings.min_df).alias("min_df"),
            F.lit(settings.max_df).alias("max_df"),
            F.lit(settings.sublinear_tf).alias("sublinear_tf"),
            F.lit(len(space.terms)).alias("tfidf_vocabulary_size"),
            F.array(*[F.lit(n) for n in NUMERIC_FEATURES]).alias("numeric_features"),
        ).alias("feature_config"),
        F.struct(scores(validation_metrics).alias("validation"), scores(test_metrics).alias("test")).alias(
            "evaluation_metrics"
        ),
        F.lit(model.is_probability).alias("confidence_is_calibrated_probability"),
        F.create_map(F.lit("0"), F.lit("REAL"), F.lit("1"), F.lit("FAKE")).alias("label_map"),
        text_map(versions).alias("package_versions"),
    )
