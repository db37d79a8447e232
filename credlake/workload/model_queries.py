"""Metrics, naive Bayes end to end, explanations, training, saved models."""
from __future__ import annotations

from pyspark.sql import functions as F

from credlake.config import DEFAULTS
from credlake.operators import linear, metrics, vectorize
from credlake.operators.common import checkpoint_dir, materialize
from credlake.plans import prediction, training
from credlake.sources import store
from credlake.workload import sql_views as q
from credlake.workload import views as v
from credlake.workload.registry import query
from credlake.workload.text_queries import fitted

# ---- metrics ----------------------------------------------------------------


@query(
    "confusion_matrix",
    """SELECT model, label AS actual, p AS predicted, count(*) FILTER (prediction = p) AS n_rows
       FROM v_predictions, (VALUES (0), (1)) t(p) GROUP BY model, label, p""",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(v.predictions(spark, sf), ["model"])


def ratio(num: str, den: str) -> str:
    return f"CAST(CASE WHEN {den} = 0 THEN 0 ELSE ({num}) / ({den})::DOUBLE END AS DOUBLE)"


SCORES = f"""round({ratio('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({ratio('tp', 'tp + fp')}, 6) AS precision,
             round({ratio('tp', 'tp + fn')}, 6) AS recall, round({ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1"""


def _rounded(df, names=("accuracy", "precision", "recall", "f1")):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "classification_scores",
    f"SELECT {SCORES} FROM (SELECT sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM v_confusion)",
)
def classification_scores(spark, sf):
    """Scores over the stacked predictions as a whole."""
    return _rounded(metrics.classification_scores(v.predictions(spark, sf)))


@query("model_comparison", f"SELECT model, {SCORES} FROM v_confusion")
def model_comparison(spark, sf):
    return _rounded(metrics.model_comparison(v.predictions(spark, sf)))


def _report_sql() -> str:
    per = {
        "REAL": (ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp"), "tn + fp"),
        "FAKE": (ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fn + fp"), "tp + fn"),
    }
    r, f, n = per["REAL"], per["FAKE"], "tn + fp + fn + tp"
    acc = ratio("tp + tn", n)
    rows = {"REAL": r, "FAKE": f, "accuracy": (acc, acc, acc, n)}
    rows["macro avg"] = (*[f"({r[i]} + {f[i]}) / 2" for i in range(3)], n)
    rows["weighted avg"] = (*[ratio(f"({r[i]} * (tn + fp) + {f[i]} * (tp + fn))", n) for i in range(3)], n)
    return " UNION ALL ".join(
        f"SELECT model, '{name}' AS class, round({a}, 6) AS precision, round({b}, 6) AS recall, round({c}, 6) AS f1, "
        f"CAST({d} AS BIGINT) AS support FROM v_confusion"
        for name, (a, b, c, d) in rows.items()
    )


@query("classification_report", _report_sql())
def classification_report(spark, sf):
    return _rounded(metrics.classification_report(v.predictions(spark, sf), ["model"]), ("precision", "recall", "f1"))


@query(
    "roc_auc",
    """SELECT model, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(n_pos) * max(n_neg))::DOUBLE, 6) AS roc_auc FROM v_curve GROUP BY model""",
)
def roc_auc(spark, sf):
    return _rounded(metrics.roc_auc(v.predictions(spark, sf), ["model"]), ["roc_auc"])


@query(
    "roc_points",
    """SELECT model, score AS threshold, round(fp / n_neg::DOUBLE, 6) AS fpr, round(tp / n_pos::DOUBLE, 6) AS tpr, round(fp / n_neg::DOUBLE, 6) AS random FROM v_curve
       UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM v_curve""",
)
def roc_points(spark, sf):
    return _rounded(metrics.roc_points(v.predictions(spark, sf), ["model"]), ("fpr", "tpr", "random"))


@query(
    "precision_recall_points",
    """SELECT model, score AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / n_pos::DOUBLE, 6) AS recall FROM v_curve
       UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM v_curve""",
)
def precision_recall_points(spark, sf):
    points = metrics.precision_recall_points(v.predictions(spark, sf), ["model"])
    return _rounded(points, ("precision", "recall"))


@query(
    "best_model",
    f"SELECT model AS best_model, f1 AS best_f1 FROM (SELECT model, {SCORES} FROM v_confusion) ORDER BY f1 DESC, list_position([{q.listed(v.MODELS)}], model) LIMIT 1",
)
def best_model(spark, sf):
    scores = metrics.model_comparison(v.predictions(spark, sf))
    return _rounded(metrics.best_model(scores, v.MODELS), ["best_f1"])


ERRORS = f"""SELECT model, doc_id, {q.decode('label')} AS actual_label, {q.decode('prediction')} AS predicted_label, round(confidence, 4) AS confidence,
       CASE WHEN label = 0 AND prediction = 1 THEN 'false_positive' WHEN label = 1 AND prediction = 0 THEN 'false_negative' ELSE 'low_confidence_correct' END AS error_type
       FROM v_predictions WHERE label <> prediction OR confidence < 0.65"""


@query("error_analysis", ERRORS)
def error_analysis(spark, sf):
    rows = metrics.error_analysis(v.predictions(spark, sf))
    return rows.select("model", "doc_id", "actual_label", "predicted_label", "confidence", "error_type")


@query("error_totals", f"SELECT error_type, count(*) AS n_rows FROM ({ERRORS}) GROUP BY error_type")
def error_totals(spark, sf):
    return metrics.error_totals(metrics.error_analysis(v.predictions(spark, sf)))


# ---- naive Bayes, exact -----------------------------------------------------


def naive_bayes(spark, sf):
    """Feature rows of the corpus, the space, and naive Bayes fitted on train."""
    rows, space = fitted(spark, sf)
    model = linear.fit_naive_bayes(rows.filter(F.col("split") == "train"), space)
    return rows, space, model


@query(
    "class_feature_sums",
    """SELECT label, feature, round(sum(value), 6) AS total FROM v_features WHERE split = 'train' AND value <> 0 GROUP BY label, feature""",
)
def class_feature_sums(spark, sf):
    rows, space = fitted(spark, sf)
    sums = linear.class_feature_sums(rows.filter(F.col("split") == "train"))
    feature = F.get(vectorize.string_array(space.names), F.col("idx"))
    return sums.select("label", feature.alias("feature"), F.round("total", 6).alias("total"))


@query("model_weights", "SELECT feature, round(weight, 6) AS weight FROM v_nb_weights")
def model_weights(spark, sf):
    _, space, model = naive_bayes(spark, sf)
    rows = linear.weight_rows(spark, model, space)
    return rows.select("feature", F.round("weight", 6).alias("weight"))


@query(
    "model_scores",
    """SELECT doc_id, label, split, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction,
              round(CASE WHEN score >= 0.5 THEN score ELSE 1.0 - score END, 6) AS confidence FROM v_nb_scores""",
)
def model_scores(spark, sf):
    rows, _, model = naive_bayes(spark, sf)
    scored = linear.with_score(rows, model)
    return scored.select(
        "doc_id", "label", "split", F.round("score", 6).alias("score"), "prediction",
        F.round("confidence", 6).alias("confidence"),
    )


@query(
    "global_top_features",
    """SELECT 'FAKE' AS indicator, feature, round(weight, 4) AS weight FROM (SELECT * FROM v_nb_weights WHERE weight > 0 ORDER BY round(weight, 9) DESC, feature LIMIT 15)
       UNION ALL SELECT 'REAL', feature, round(weight, 4) FROM (SELECT * FROM v_nb_weights WHERE weight < 0 ORDER BY round(weight, 9), feature LIMIT 15)""",
)
def global_top_features(spark, sf):
    _, space, model = naive_bayes(spark, sf)
    return linear.global_top_features(linear.weight_rows(spark, model, space))


CONTRIBUTIONS = """SELECT doc_id, feature, value * weight AS c,
       row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(value * weight), 10) DESC, feature) AS rank
       FROM {features} JOIN v_nb_weights USING (feature) WHERE value <> 0"""


@query(
    "local_contributions",
    f"""SELECT doc_id, rank, feature, round(c, 6) AS contribution, CASE WHEN c > 0 THEN 'FAKE' ELSE 'REAL' END AS direction
        FROM ({CONTRIBUTIONS.format(features='v_features')}) WHERE rank <= 10""",
)
def local_contributions(spark, sf):
    """Contribution rows by a join of feature and weight tables, top 10 per document."""
    rows, space, model = naive_bayes(spark, sf)
    pairs = vectorize.to_long(rows, ["doc_id"], space)
    joined = linear.contributions(pairs, linear.weight_rows(spark, model, space))
    top = linear.local_top_contributions(joined, "doc_id")
    return top.select("doc_id", "rank", "feature", F.round("contribution", 6).alias("contribution"), "direction")


def articles_to_score(spark, sf):
    """All news as unlabelled input, every tenth article blank."""
    blank = F.col("doc_id") % 10 == 9
    return v.news(spark, sf).select(
        "doc_id",
        F.when(blank, " ").otherwise(F.col("title")).alias("headline"),
        F.when(blank, "").otherwise(F.col("text")).alias("article"),
    )


PREDICTED = f"""
    SELECT doc_id, CASE WHEN ok THEN CASE WHEN score >= 0.5 THEN 'FAKE' ELSE 'REAL' END END AS prediction,
           CASE WHEN ok THEN round(c, 4) END AS confidence, CASE WHEN ok THEN {q.level('c')} ELSE 'Unknown' END AS confidence_level
    FROM (SELECT doc_id, score, content <> '' AS ok, CASE WHEN score >= 0.5 THEN score ELSE 1.0 - score END AS c
          FROM v_cut_nb_scores JOIN v_cut_clean_news USING (doc_id))"""


@query("batch_predictions", PREDICTED)
def batch_predictions(spark, sf):
    _, space, model = naive_bayes(spark, sf)
    rows = prediction.predict_batch(articles_to_score(spark, sf), space, model)
    return rows.select("doc_id", "prediction", "confidence", "confidence_level")


@query(
    "explained_predictions",
    f"""SELECT p.*, true AS is_calibrated_probability, 'MultinomialNB' AS model,
               CASE WHEN prediction IS NOT NULL THEN t.top END AS top_features
        FROM ({PREDICTED}) p LEFT JOIN (
          SELECT doc_id, string_agg(feature || ':' || CASE WHEN c > 0 THEN 'FAKE' ELSE 'REAL' END, ' | ' ORDER BY rank) AS top
          FROM ({CONTRIBUTIONS.format(features='v_cut_features')}) WHERE rank <= 10 GROUP BY doc_id) t ON p.doc_id = t.doc_id""",
)
def explained_predictions(spark, sf):
    _, space, model = naive_bayes(spark, sf)
    rows = prediction.predict_explained(articles_to_score(spark, sf), space, model)
    shown = F.transform("top_features", lambda s: F.concat(s["feature"], F.lit(":"), s["direction"]))
    return rows.select(
        "doc_id", "prediction", "confidence", "confidence_level", "is_calibrated_probability", "model",
        F.array_join(shown, " | ").alias("top_features"),
    )


@query("saved_model_predictions", PREDICTED)
def saved_model_predictions(spark, sf):
    """Predictions after writing the model tables and reading them back."""
    import uuid

    _, space, model = naive_bayes(spark, sf)
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    store.save_model(spark, path, space, model)
    space, model = store.load_model(spark, path)
    rows = prediction.predict_batch(articles_to_score(spark, sf), space, model)
    return rows.select("doc_id", "prediction", "confidence", "confidence_level")


# ---- training (iterative: checked by invariants, no SQL form) ---------------


def _features(spark, sf):
    prepared = materialize(
        v.engineered_news(spark, sf).withColumn("fold", F.pmod(F.xxhash64("content"), F.lit(DEFAULTS.cv_folds)).cast("int")),
        "prepared",
    )
    return (prepared, *training.featurize(prepared))


def _weights(spark, sf, name: str, **params):
    _, features, space = _features(spark, sf)
    model = training.fit(name, features.filter(F.col("split") == "train"), space, params)
    return linear.weight_rows(spark, model, space)


@query("logistic_regression_weights")
def logistic_regression_weights(spark, sf):
    return _weights(spark, sf, "LogisticRegression", C=1.0)


@query("linear_svc_weights")
def linear_svc_weights(spark, sf):
    return _weights(spark, sf, "LinearSVC", C=1.0)


def _gradient(spark, sf, name: str):
    """Largest part of the objective's gradient at the fitted weights, by joins of feature and weight rows."""
    _, features, space = _features(spark, sf)
    train = features.filter(F.col("split") == "train")
    model = training.fit(name, train, space, {"C": 1.0})
    weights = linear.weight_rows(spark, model, space).select("idx", "weight")
    sign = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    # the constant is a feature that is 1 everywhere, beyond the last index
    constant = spark.range(1).select(F.lit(space.size).cast("int").alias("idx"), F.lit(model.bias).alias("weight"))
    weights = materialize(weights.select(F.col("idx").cast("int"), "weight").unionByName(constant), "weights")
    cells = train.select(
        "doc_id", sign.alias("y"),
        F.explode(F.map_from_arrays(F.concat("idx", F.array(F.lit(space.size))), F.concat("val", F.array(F.lit(1.0))))).alias("idx", "value"),
    )
    margins = cells.join(weights, "idx").groupBy("doc_id", "y").agg(F.sum(F.col("value") * F.col("weight")).alias("m"))
    margin = F.col("y") * F.col("m")
    if name == "LinearSVC":
        slope = -2.0 * F.greatest(F.lit(0.0), 1.0 - margin) * F.col("y")
    else:
        slope = -F.col("y") / (1.0 + F.exp(margin))
    back = cells.join(margins.select("doc_id", slope.alias("slope")), "doc_id").groupBy("idx").agg(F.sum(F.col("value") * F.col("slope")).alias("g"))
    penalty = F.when((F.col("idx") == space.size) & F.lit(name != "LinearSVC"), 0.0).otherwise(F.col("weight"))
    parts = weights.join(back, "idx", "left").select((F.coalesce("g", F.lit(0.0)) + penalty).alias("g"))
    return parts.agg(F.count(F.lit(1)).alias("n_components"), F.count_if(F.abs("g") > 1e-4).alias("n_above")).select(F.lit(name).alias("model"), "n_components", "n_above")


@query("linear_svc_gradient", "SELECT 'LinearSVC' AS model, count(*) + 1 AS n_components, 0 AS n_above FROM v_nb_weights")
def linear_svc_gradient(spark, sf):
    """No component of the squared-hinge objective's gradient is left above the tolerance."""
    return _gradient(spark, sf, "LinearSVC")


@query("logistic_regression_gradient", "SELECT 'LogisticRegression' AS model, count(*) + 1 AS n_components, 0 AS n_above FROM v_nb_weights")
def logistic_regression_gradient(spark, sf):
    """The same certificate for logistic regression."""
    return _gradient(spark, sf, "LogisticRegression")


@query("passive_aggressive_weights")
def passive_aggressive_weights(spark, sf):
    return _weights(spark, sf, "PassiveAggressiveClassifier", C=1.0)


@query("tuned_naive_bayes")
def tuned_naive_bayes(spark, sf):
    """Cross-validated choice of the smoothing parameter, and the random search list."""
    _, features, space = _features(spark, sf)
    train = features.filter(F.col("split") == "train")
    sets = training.parameter_sets(training.FULL_GRIDS["MultinomialNB"])
    best = training.tune("MultinomialNB", train, space, sets)
    return spark.range(1).select(F.lit("MultinomialNB").alias("model"), F.lit(best["alpha"]).alias("alpha"))


@query("trained_model_comparison")
def trained_model_comparison(spark, sf):
    """All four models fitted on train and measured on validation in one pass."""
    _, features, space = _features(spark, sf)
    models = training.train_models(features, space, tuning=False)
    held_out = features.filter(F.col("split") == "validation")
    return metrics.evaluation(linear.stacked_scores(held_out, models), ["model"])


@query("training_metadata")
def training_metadata(spark, sf):
    """Metadata row of a naive Bayes run."""
    prepared, features, space = _features(spark, sf)
    model = linear.fit_naive_bayes(features.filter(F.col("split") == "train"), space)
    scored = linear.stacked_scores(features, [model])
    measured = {
        s: materialize(metrics.evaluation(scored.filter(F.col("split") == s), ["model"]), s)
        for s in ("validation", "test")
    }
    row = training.model_metadata(prepared, space, model, measured["validation"], measured["test"])
    return row.select(
        "model_name",
        "dataset_info.n_total",
        "dataset_info.n_train",
        "feature_config.tfidf_vocabulary_size",
        F.to_json("evaluation_metrics").alias("evaluation_metrics"),
    )
