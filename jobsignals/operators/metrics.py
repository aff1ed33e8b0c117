"""Scores of predictions, comparison of classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASSIFIERS, LABELS, METRICS, POSITIVE
from ..functions.numbers import ratio


def predictions(
    df: DataFrame,
    key: str = "episode_id",
    family: str = "scenario_family",
    label: str = "label",
    predicted: str = "predicted",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The five columns of a prediction table, after those to ``keep``."""
    return df.select(
        *keep,
        F.col(key).alias("episode_id"),
        F.col(family).alias("scenario_family"),
        F.col(label).alias("label"),
        F.col(predicted).alias("predicted"),
        F.coalesce(F.col(label) == F.col(predicted), F.lit(False)).alias("correct"),
    )


def _scores(tp: Column, fp: Column, fn: Column, correct: Column, n: Column, accuracy_default) -> list[Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [
        ratio(correct, n, accuracy_default).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2.0 * precision * recall, precision + recall).alias("f1"),
    ]


def binary_metrics(
    pred: DataFrame,
    positive: str = POSITIVE,
    by: Sequence[str] = (),
    label: str = "label",
    predicted: str = "predicted",
) -> DataFrame:
    """Accuracy, precision, recall and f1, one row per ``by`` group, in one pass.

    A ratio whose denominator is zero is 0.
    """
    is_pos, said_pos = F.col(label).eqNullSafe(positive), F.col(predicted).eqNullSafe(positive)
    counts = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_pos & said_pos).alias("tp"),
        F.count_if(~is_pos & said_pos).alias("fp"),
        F.count_if(is_pos & ~said_pos).alias("fn"),
        F.count_if(F.col(label) == F.col(predicted)).alias("hits"),
    )
    c = F.col
    return counts.select(*by, "n", *_scores(c("tp"), c("fp"), c("fn"), c("hits"), c("n"), 0.0))


def valid_only_metrics(
    pred: DataFrame,
    labels: Sequence[str] = LABELS,
    positive: str = POSITIVE,
    by: Sequence[str] = (),
    label: str = "label",
    predicted: str = "predicted",
) -> DataFrame:
    """Scores over answers that name a label; others are counted but do not enter.

    Accuracy is null when no answer is valid. Family accuracies of the same predictions use all
    answers: see :func:`family_accuracy`.
    """
    negative = [x for x in labels if x != positive]
    valid = F.col(predicted).isin(list(labels))
    is_pos, is_neg = F.col(label) == positive, F.col(label).isin(negative)
    said_pos, said_neg = F.col(predicted) == positive, F.col(predicted).isin(negative)
    counts = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(is_pos & said_pos).alias("tp"),
        F.count_if(is_neg & said_pos).alias("fp"),
        F.count_if(is_pos & said_neg).alias("fn"),
        F.count_if(valid & (F.col(label) == F.col(predicted))).alias("hits"),
    )
    c = F.col
    return counts.select(*by, "n", "n_valid", *_scores(c("tp"), c("fp"), c("fn"), c("hits"), c("n_valid"), None))


def confusion_matrix(
    pred: DataFrame,
    labels: Sequence[str] = LABELS,
    by: Sequence[str] = (),
    label: str = "label",
    predicted: str = "predicted",
) -> DataFrame:
    """One row per (label, predicted) pair of the given labels, zero counts included."""
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(a).alias("label"),
            F.lit(b).alias("predicted"),
            F.count_if((F.col(label) == a) & (F.col(predicted) == b)).alias("count"),
        )
        for i, (a, b) in enumerate((a, b) for a in labels for b in labels)
    ]
    return pred.groupBy(*by).agg(F.array(*cells).alias("_cells")).select(*by, F.inline("_cells"))


def family_accuracy(
    pred: DataFrame, family: str = "scenario_family", correct: str = "correct", by: Sequence[str] = ()
) -> DataFrame:
    """Predictions and share of correct ones per family."""
    return pred.groupBy(*by, F.col(family).alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy")
    )


def compare(families: DataFrame, classifiers: Sequence[str] | None = CLASSIFIERS) -> DataFrame:
    """Accuracy by family (rows) and classifier (columns), null where a classifier has none.

    ``families`` has classifier, family and accuracy. ``None`` takes the classifiers found.
    """
    if classifiers is None:
        classifiers = [r[0] for r in families.select("classifier").distinct().orderBy("classifier").collect()]
    return families.groupBy("family").pivot("classifier", list(classifiers)).agg(F.first("accuracy")).orderBy("family")


def chart_data(
    metrics: DataFrame, comparison: DataFrame, names: Sequence[str] = METRICS
) -> tuple[DataFrame, DataFrame]:
    """Long form of both tables for charts, one row per bar; a missing value is drawn as 0."""
    zero = F.lit(0.0)
    scores = metrics.select("classifier", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        "classifier", list(names), "metric", "value"
    )
    columns = [c for c in comparison.columns if c != "family"]
    families = comparison.unpivot("family", columns, "classifier", "accuracy")
    return (
        scores.withColumn("value", F.coalesce("value", zero)),
        families.withColumn("accuracy", F.coalesce("accuracy", zero)),
    )
