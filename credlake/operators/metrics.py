"""Classifier metrics from stacked predictions (model, label, prediction, score)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlake.config import DEFAULTS, Settings
from credlake.functions.text import decode_label


def _ratio(num: Column, den: Column) -> Column:
    """Quotient with zero for an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True/false negatives and positives of FAKE per group, in one aggregate."""
    y, p = F.col("label"), F.col("prediction")
    return df.groupBy(*(by or [])).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion_matrix(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion matrix as rows (actual, predicted, n_rows), labels 0 and 1."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n_rows"))
            for a, p, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
        ]
    )
    return confusion_counts(df, by).select(*(by or []), F.inline(cells))


def with_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of FAKE from confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_scores(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return with_scores(confusion_counts(df, by)).drop("tn", "fp", "fn", "tp")


def classification_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per-class rows, accuracy, macro and weighted averages.

    Everything derives from one row of four counts per group; the rows are unrolled
    from it instead of scanning again.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    real, fake, total = tn + fp, fn + tp, tn + fp + fn + tp
    per_class = {
        "REAL": (_ratio(tn, tn + fn), _ratio(tn, real), _ratio(2 * tn, 2 * tn + fn + fp), real),
        "FAKE": (_ratio(tp, tp + fp), _ratio(tp, fake), _ratio(2 * tp, 2 * tp + fp + fn), fake),
    }
    accuracy = _ratio(tp + tn, total)

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("long").alias("support"),
        )

    r, f = per_class["REAL"], per_class["FAKE"]
    macro = [(r[i] + f[i]) / 2 for i in range(3)]
    weighted = [_ratio(r[i] * real + f[i] * fake, total) for i in range(3)]
    rows = F.array(
        row("REAL", *r),
        row("FAKE", *f),
        row("accuracy", accuracy, accuracy, accuracy, total),
        row("macro avg", *macro, total),
        row("weighted avg", *weighted, total),
    )
    return confusion_counts(df, by).select(*(by or []), F.inline(rows))


# ---- curves -----------------------------------------------------------------


def _score_counts(df: DataFrame, by: list[str], decimals: int | None) -> DataFrame:
    score = F.col("score") if decimals is None else F.round("score", decimals)
    return df.groupBy(*by, score.alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def cumulative_counts(
    df: DataFrame, by: list[str] | None = None, slices: int = 256, decimals: int | None = None
) -> DataFrame:
    """Positives and negatives at or above each distinct score, per group.

    Rows are first reduced to distinct scores. The running sum then works in score
    slices: totals per slice give each slice its start, and only rows of one slice
    are ordered together. Slice borders are approximate quantiles of the scores, so
    slices stay even however the scores pile up; being literals, they cannot differ
    between the two uses. ``decimals`` rounds scores first (approximate curve).
    """
    by = by or []
    counts = _score_counts(df, by, decimals)
    borders = _slice_borders(df, by, slices)
    staged = counts.withColumn("__slice", _slice_of(F.col("score"), borders))
    totals = staged.groupBy(*by, "__slice").agg(
        F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg")
    )
    above = (
        Window.partitionBy(*by).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    )
    group = Window.partitionBy(*by)
    starts = totals.select(
        *by,
        "__slice",
        F.coalesce(F.sum("__pos").over(above), F.lit(0)).alias("__pos_above"),
        F.coalesce(F.sum("__neg").over(above), F.lit(0)).alias("__neg_above"),
        F.sum("__pos").over(group).alias("n_pos"),
        F.sum("__neg").over(group).alias("n_neg"),
    )
    inside = (
        Window.partitionBy(*by, "__slice")
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        staged.select(
            *by,
            "__slice",
            "score",
            "pos",
            "neg",
            F.sum("pos").over(inside).alias("__pos_in"),
            F.sum("neg").over(inside).alias("__neg_in"),
        )
        .join(starts, [*by, "__slice"])
        .select(
            *by,
            "score",
            "pos",
            "neg",
            (F.col("__pos_above") + F.col("__pos_in")).alias("tp"),
            (F.col("__neg_above") + F.col("__neg_in")).alias("fp"),
            "n_pos",
            "n_neg",
        )
    )


def _slice_borders(df: DataFrame, by: list[str], slices: int) -> list[float]:
    """At most ``slices - 1`` score quantiles, taken to the driver."""
    points = [i / slices for i in range(1, slices)]
    row = df.agg(F.percentile_approx("score", points, 10000).alias("q")).first()
    return sorted(set(row["q"] or []))


def _slice_of(score: Column, borders: list[float]) -> Column:
    if not borders:
        return F.lit(0)
    literal = F.split(F.lit(",".join(repr(b) for b in borders)), ",").cast("array<double>")
    return F.size(F.filter(literal, lambda border: border <= score))


def roc_auc(
    df: DataFrame, by: list[str] | None = None, slices: int = 256, decimals: int | None = None
) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when one class is missing."""
    by = by or []
    cumulative = cumulative_counts(df, by, slices, decimals)
    # negatives of this score meet all positives above it and half of those at it
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    sums = cumulative.groupBy(*by).agg(
        F.sum(area).alias("__area"), F.max("n_pos").alias("__p"), F.max("n_neg").alias("__n")
    )
    pairs = F.col("__p").cast("double") * F.col("__n")
    return sums.select(*by, F.when(pairs > 0, F.col("__area") / pairs).alias("roc_auc"))


def roc_points(df: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    """(threshold, fpr, tpr, random) per distinct score, plus the origin."""
    by = by or []
    points = cumulative_counts(df, by, **options).select(
        *by,
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )
    origin = df.groupBy(*by).agg(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin).withColumn("random", F.col("fpr"))


def precision_recall_points(df: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the end point (1, 0)."""
    by = by or []
    points = cumulative_counts(df, by, **options).select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("n_pos") == 0, 1.0).otherwise(F.col("tp") / F.col("n_pos")).alias("recall"),
    )
    end = df.groupBy(*by).agg(
        F.lit(float("inf")).alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


# ---- model comparison and error analysis ------------------------------------


def model_comparison(df: DataFrame) -> DataFrame:
    """All scores per model in one pass over the stacked predictions."""
    return classification_scores(df, ["model"])


def evaluation(df: DataFrame, by: list[str]) -> DataFrame:
    """Scores, confusion counts and ROC AUC per group."""
    scores = with_scores(confusion_counts(df, by))
    return scores.join(roc_auc(df, by), by, "left")


def best_model(metrics: DataFrame, order: list[str]) -> DataFrame:
    """Model with the highest F1; on ties the first in ``order`` (then by name)."""
    position = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    rank = F.struct(
        F.col("f1"), F.when(position > 0, -position).otherwise(-len(order) - 1).alias("position")
    )
    return metrics.agg(
        F.max_by("model", rank).alias("best_model"), F.max("f1").alias("best_f1")
    )


def error_analysis(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Wrong rows, and right rows of low confidence, each with its error type."""
    wrong = F.col("label") != F.col("prediction")
    unsure = F.coalesce(
        (F.col("confidence") < settings.medium_confidence) & ~F.isnan("confidence"), F.lit(False)
    )
    kind = (
        F.when(wrong & (F.col("label") == 0), "false_positive")
        .when(wrong & (F.col("label") == 1), "false_negative")
        .when(wrong, "misclassified")
        .otherwise("low_confidence_correct")
    )
    return df.filter(wrong | unsure).withColumns(
        {
            "actual_label": decode_label(F.col("label")),
            "predicted_label": decode_label(F.col("prediction")),
            "confidence": F.round("confidence", 4),
            "error_type": kind,
        }
    )


def error_totals(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n_rows"))
