"""Processed tables to cross-validated results, one function per classifier family."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import KEY_FIELDS, LABELS, POSITIVE
from ..functions.text import parse_answer
from ..operators import metrics as M
from ..operators.cohort import feature_columns, fill_features, require_rows
from ..operators.joins import fuse_features
from ..operators.models import (
    Estimator,
    FusedForest,
    TelemetryForest,
    TextLogistic,
    TextSVM,
    TextVectorizer,
    out_of_fold,
    top_importances,
    top_terms,
)
from ..operators.ranking import stratified_folds
from ..operators.stacked import LOGISTIC, Loss, fit_stack
from ..session import materialise
from ..sources.tables import write_results


def scored(pred: DataFrame) -> dict[str, DataFrame]:
    return {
        "predictions": pred,
        "metrics": M.binary_metrics(pred, POSITIVE),
        "confusion": M.confusion_matrix(pred, LABELS),
        "families": M.family_accuracy(pred),
    }


def run_row(rows: DataFrame, folds: int, seed: int, model: str, settings: dict[str, object]) -> DataFrame:
    return rows.agg(
        F.lit(folds).alias("folds"), F.lit(seed).alias("seed"), F.lit(model).alias("model"),
        F.count(F.lit(1)).alias("n_episodes"), F.lit(json.dumps(settings)).alias("settings"),
    )


def classify(
    features: DataFrame, estimator: Estimator, folds: int = 5, seed: int = 0, describe: bool = True
) -> dict[str, DataFrame]:
    """Out-of-fold predictions of one classifier with their scores.

    ``features`` has the three key columns and what the estimator reads. The final fit on all
    rows only describes the model; no score comes from it.
    """
    require_rows(features, folds)
    dealt = stratified_folds(features, k=folds, seed=seed)
    prepared = materialise(estimator.prepare(dealt, [*KEY_FIELDS, "fold"]))
    pred = materialise(M.predictions(out_of_fold(prepared, estimator, folds)))
    out = scored(pred) | {"runs": run_row(prepared, folds, seed, type(estimator).__name__, estimator.settings())}
    if describe:
        fitted = estimator.fit_stacked(prepared) if estimator.stacks else estimator.fit(prepared)
        is_forest = isinstance(estimator, TelemetryForest)
        out["terms"] = (top_importances if is_forest else top_terms)(fitted, features)
    return out


def classify_stacked(
    features: DataFrame, loss: Loss, column: str = "text_normalized", C: float = 1.0, folds: int = 5, seed: int = 0,
    max_iter: int = 1000, tol: float = 1e-4,
) -> dict[str, DataFrame]:
    """As ``classify`` for linear models of text, with all folds and the fit on all rows as one fit.

    Coefficients are tables, so that the vocabulary has no limit; a step takes seconds on tables of any size.
    """
    require_rows(features, folds)
    dealt = materialise(stratified_folds(features.select(*KEY_FIELDS, column), k=folds, seed=seed))
    stack = fit_stack(dealt, loss, column, folds, C, max_iter, tol)
    given = dealt.select(*KEY_FIELDS).join(stack.predictions().drop("fold"), "episode_id")
    pred = materialise(M.predictions(given))
    settings = {"text": column, "C": C, "max_iter": max_iter, "tol": tol, "steps": stack.steps}
    name = "StackedLogistic" if loss is LOGISTIC else "StackedSVM"
    return scored(pred) | {"runs": run_row(dealt, folds, seed, name, settings), "terms": stack.top_terms()}


def text_classifier(text: DataFrame, column: str = "text_normalized", C: float = 1.0, folds: int = 5, seed: int = 0):
    return classify(fill_features(text, texts=[column]), TextLogistic(text=column, C=C, seed=seed), folds, seed)


def text_svm_classifier(text: DataFrame, column: str = "text_normalized", C: float = 1.0, folds: int = 5, seed: int = 0):
    return classify(fill_features(text, texts=[column]), TextSVM(text=column, C=C, seed=seed), folds, seed)


def telemetry_classifier(gpu: DataFrame, num_trees: int = 200, folds: int = 5, seed: int = 0):
    names = feature_columns(gpu)
    return classify(fill_features(gpu, names), TelemetryForest(numbers=names, num_trees=num_trees, seed=seed), folds, seed)


def combined_classifier(
    text: DataFrame,
    gpu: DataFrame,
    column: str = "text_normalized",
    num_trees: int = 200,
    max_depth: int = 30,
    min_leaf: int = 1,
    max_terms: int | None = None,
    folds: int = 5,
    seed: int = 0,
):
    """Forest on text and telemetry together, over the episodes that have both."""
    names = feature_columns(gpu)
    both = fill_features(fuse_features(text.select(*KEY_FIELDS, column), gpu), names, [column])
    estimator = FusedForest(
        numbers=names, text=column, num_trees=num_trees, max_depth=max_depth, min_leaf=min_leaf, seed=seed,
        vectorizer=TextVectorizer(max_terms),
    )
    return classify(both, estimator, folds, seed)


def combined_shrunk_classifier(text: DataFrame, gpu: DataFrame, **settings):
    """The combined forest, small and shallow."""
    return combined_classifier(text, gpu, **({"num_trees": 50, "max_depth": 4, "min_leaf": 2} | settings))


def answered(features: DataFrame, answers: DataFrame, answer: str = "answer") -> dict[str, DataFrame]:
    """Results from free-text answers given elsewhere, one row per episode.

    An episode without an answer counts as an answer that names no label.
    """
    joined = features.select(*KEY_FIELDS).join(answers.select("episode_id", answer), "episode_id", "left")
    pred = M.predictions(joined.withColumn("predicted", parse_answer(answer)))
    return {
        "predictions": pred,
        "metrics": M.valid_only_metrics(pred),
        "families": M.family_accuracy(pred),
    }


def run_all(
    spark: SparkSession,
    text: DataFrame,
    gpu: DataFrame,
    out: str,
    only: Sequence[str] | None = None,
    folds: int = 5,
    seed: int = 0,
) -> list[str]:
    """Run the classifiers and write their results; returns the names that were run."""
    runs: dict[str, Callable[[], dict[str, DataFrame]]] = {
        "text": lambda: text_classifier(text, folds=folds, seed=seed),
        "text_svm": lambda: text_svm_classifier(text, folds=folds, seed=seed),
        "nvml": lambda: telemetry_classifier(gpu, folds=folds, seed=seed),
        "combined": lambda: combined_classifier(text, gpu, folds=folds, seed=seed),
        "combined_shrunk": lambda: combined_shrunk_classifier(text, gpu, folds=folds, seed=seed),
    }
    names = [n for n in runs if only is None or n in only]
    for name in names:
        write_results(name, out, **runs[name]())
    return names
