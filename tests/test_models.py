"""Metrics against brute force; models by invariants."""
from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from credlake.config import Settings
from credlake.errors import EmptyInputError, ModelNotFoundError
from credlake.operators import linear, metrics, shards, vectorize
from credlake.plans import prediction, training
from credlake.sources import store


def test_random_search_draws_a_repeatable_part_of_the_grid():
    grid = training.FULL_GRIDS["LogisticRegression"]
    whole = training.parameter_sets(grid)
    drawn = [training.parameter_sets(grid, Settings(search_type="random", random_search_iterations=n, seed=3)) for n in (5, 5, 99)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 5
    assert all(p in whole for p in drawn[0]) and len({str(p) for p in drawn[0]}) == 5
    assert sorted(map(str, drawn[2])) == sorted(map(str, whole))


def scored(spark, rows):
    df = spark.createDataFrame(rows, "model string, label int, score double")
    return linear.with_prediction(df)


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("slices", [1, 3, 256])
def test_roc_auc_equals_pair_count(spark, slices):
    rng = random.Random(5)
    rows = [(m, rng.randint(0, 1), round(rng.random() ** 3, 2)) for m in "ab" for _ in range(300)]
    got = {r["model"]: r["roc_auc"] for r in metrics.roc_auc(scored(spark, rows), ["model"], slices=slices).collect()}
    for model in "ab":
        assert got[model] == pytest.approx(brute_auc([(y, s) for m, y, s in rows if m == model]))


def test_roc_auc_edges(spark):
    assert metrics.roc_auc(scored(spark, [("a", 1, 0.2), ("a", 1, 0.4)]), ["model"]).first()["roc_auc"] is None
    tied = [("a", y, 0.5) for y in (0, 1, 1, 0)]
    assert metrics.roc_auc(scored(spark, tied), ["model"]).first()["roc_auc"] == 0.5


def test_zero_division_gives_zero(spark):
    row = metrics.classification_scores(scored(spark, [("a", 1, 0.1), ("a", 0, 0.2)])).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.5, 0.0, 0.0, 0.0)


def test_best_model_prefers_the_first_on_ties(spark):
    df = spark.createDataFrame([("MultinomialNB", 0.5), ("LogisticRegression", 0.5), ("LinearSVC", 0.4)], "model string, f1 double")
    assert metrics.best_model(df, linear.MODEL_ORDER).first()["best_model"] == "LogisticRegression"


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([("",), ("one",), ("one two",), ("aa bb cc",)], "clean_text string")
    got = [r["terms"] for r in vectorize.with_terms(df).collect()]
    assert got == [[], ["one"], ["one", "two", "one two"], ["aa", "bb", "cc", "aa bb", "bb cc"]]


@pytest.fixture(scope="module")
def trained(spark, tiny_news, small_settings):
    prepared = training.prepare(tiny_news, ["doc_id"], small_settings)
    features, space = training.featurize(prepared, small_settings)
    return prepared, features, space


def test_rows_have_unit_length_and_scaled_numbers(trained):
    _, features, space = trained
    n = len(space.terms)
    for row in features.collect():
        text = sum(v * v for i, v in zip(row["idx"], row["val"]) if i < n)
        assert text == pytest.approx(1.0) or text == 0.0
        assert all(0.0 < v <= 1.0 for i, v in zip(row["idx"], row["val"]) if i >= n)
        assert list(row["features"].indices) == row["idx"]


def test_naive_bayes_closed_form(trained):
    _, features, space = trained
    train = features.filter(F.col("split") == "train")
    model = linear.fit_naive_bayes(train, space, alpha=0.5)
    sums = [[0.5] * space.size, [0.5] * space.size]
    counts = [0, 0]
    for row in train.collect():
        counts[row["label"]] += 1
        for i, v in zip(row["idx"], row["val"]):
            sums[row["label"]][i] += v
    for i in (0, space.size // 2, space.size - 1):
        want = math.log(sums[1][i] / sum(sums[1])) - math.log(sums[0][i] / sum(sums[0]))
        assert model.weights[i] == pytest.approx(want)
    assert model.bias == pytest.approx(math.log(counts[1] / counts[0]))


def test_fold_models_leave_their_fold_out(trained):
    _, features, space = trained
    train = features.filter(F.col("split") == "train")
    models = linear.fit_naive_bayes_folds(train, space, [1.0])
    direct = linear.fit_naive_bayes(train.filter(F.col("fold") != 1), space, 1.0)
    assert models[1, 1.0].weights == pytest.approx(direct.weights)
    by_fold = linear.fold_scores(train, {(f, 0): m for (f, _), m in models.items()}, space.size)
    apart = linear.with_score(train.filter("fold = 1"), models[1, 1.0])
    assert sorted(r["prediction"] for r in by_fold.filter("fold = 1").collect()) == sorted(r["prediction"] for r in apart.collect())


def test_training_run_and_predictions(spark, tiny_news, small_settings, tmp_path):
    run = training.run_training(tiny_news, ["doc_id"], small_settings, quick=True, tuning=False)
    assert [m.name for m in run.models] == linear.MODEL_ORDER
    assert {r["model"]: r["f1"] for r in run.validation_metrics.collect()}[run.best_model.name] > 0.9
    assert run.metadata.first()["dataset_info"]["n_total"] == 80

    articles = spark.createDataFrame(
        [(1, "", "UNBELIEVABLE!!! The secret tram plan they hide!!!"), (2, "Report", "The council published its report on the museum fund."), (3, " ", "")],
        "id int, Headline string, body string",
    )
    store.save_model(spark, str(tmp_path / "m"), run.space, run.best_model)
    space, model = store.load_model(spark, str(tmp_path / "m"))
    rows = {r["id"]: r for r in prediction.predict_explained(articles, space, model).collect()}
    assert (rows[1]["prediction"], rows[2]["prediction"]) == ("FAKE", "REAL")
    assert rows[3]["prediction"] is None and rows[3]["confidence"] is None and rows[3]["confidence_level"] == "Unknown"
    assert 0.5 <= rows[1]["confidence"] <= 1.0 and len(rows[1]["top_features"]) == 10
    weights = [abs(f["weight"]) for f in rows[1]["top_features"]]
    assert weights == sorted(weights, reverse=True)
    same = {r["id"]: r["confidence"] for r in prediction.predict_batch(articles, run.space, run.best_model).collect()}
    assert same == {i: rows[i]["confidence"] for i in rows}
    with pytest.raises(EmptyInputError):
        prediction.predict_batch(spark.createDataFrame([(1,)], "unrelated int"), space, model)
    with pytest.raises(ModelNotFoundError):
        store.load_model(spark, str(tmp_path / "none"))


def test_contributions_sum_to_margin(trained):
    _, features, space = trained
    model = linear.fit_naive_bayes(features.filter("split = 'train'"), space)
    whole = features.withColumn("m", linear.margin(model)).withColumn("top", linear.top_features(model, space, 10**6))
    for row in whole.limit(10).collect():
        assert model.bias + sum(f["weight"] for f in row["top"]) == pytest.approx(row["m"], abs=0.01)


def test_tuning_returns_a_grid_member(trained, small_settings):
    _, features, space = trained
    train = features.filter("split = 'train'")
    for name in ("MultinomialNB", "PassiveAggressiveClassifier", "LogisticRegression"):
        sets = training.parameter_sets(training.QUICK_GRIDS[name], small_settings)
        assert training.tune(name, train, space, sets, small_settings) in sets


def test_training_rows_are_dealt_to_shards_once(trained, small_settings, monkeypatch):
    """The models that are fitted over shards share them, and are those fitted one by one."""
    _, features, space = trained
    calls, sharded = [], shards.sharded
    monkeypatch.setattr(shards, "sharded", lambda *a: calls.append(a) or sharded(*a))
    models = training.train_models(features, space, small_settings, tuning=False)
    assert len(calls) == 1 and [m.name for m in models] == linear.MODEL_ORDER
    alone = training.fit("LinearSVC", features.filter("split = 'train'"), space, {})
    assert len(calls) == 2 and models[2].weights == pytest.approx(alone.weights, abs=1e-6)


def test_news_of_one_row_group_is_spread_over_tasks(spark, tmp_path):
    """A file of one row group is read by one task; the work on its texts is not left there."""
    from credlake.workload import model_queries, views

    docs = [(n, f"Title {n}. Some words of text {n}", "en", "s", 30) for n in range(400)]
    spark.createDataFrame(docs, views.SCHEMAS["documents"]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(n, n % 2, 0) for n in range(0, 400, 2)]
    spark.createDataFrame(labels, views.SCHEMAS["labels"]).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (model_queries.articles_to_score(spark, str(tmp_path)), views.clean_news(spark, str(tmp_path))):
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == (400 if len(rows.columns) == 3 else 200)
        assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4
