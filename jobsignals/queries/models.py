"""Classifiers over the driver tables: labelled documents as text, users as episodes with
telemetry. Predictions have no SQL unless a planted word gives the class away."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import KEY_FIELDS, LABELS
from ..operators import joins, models, stacked
from ..operators.cohort import feature_columns, fill_features
from ..operators.ranking import stratified_folds
from ..operators.series import gpu_features
from ..plans import training
from ..plans.features import with_text
from ..session import materialise
from .evaluation import labelled
from .registry import ORDER, event_series, query, rounded, table
from .series import METRICS, customers, network_rows, process_rows


def document_features(spark, sf):
    """Labelled documents: language is the family, toxic the class, the whole text the text."""
    return labelled(spark, sf).select(
        F.col("doc_id").alias("episode_id"),
        F.when(F.col("toxic") == 1, LABELS[1]).otherwise(LABELS[0]).alias("label"),
        F.col("lang").alias("scenario_family"),
        F.col("text").alias("text_normalized"),
    )


def user_tables(spark, sf):
    """Text and GPU feature tables of the users, from their customer row and their events."""
    e = event_series(spark, sf)
    wide = e.select(
        "episode_id", *ORDER, *[F.when(F.col("metric") == m, F.col("value")).alias(m) for m in METRICS if m != "value"],
        "value", F.when(F.col("metric") == "error", F.col("props")).alias("error"),
    )
    keyed = customers(spark, sf).withColumns(
        {
            "label": F.when(F.col("c_acctbal") < 4500, LABELS[1]).otherwise(LABELS[0]),
            "scenario_family": F.col("c_mktsegment"),
        }
    )
    text = with_text(keyed, network_rows(spark, sf), process_rows(spark, sf), ["c_mktsegment", "c_nationkey", "c_acctbal"])
    gpu = keyed.select(*KEY_FIELDS).join(gpu_features(wide, METRICS, order=ORDER), "episode_id")
    return materialise(text.select(*KEY_FIELDS, "text_raw", "text_normalized")), materialise(gpu)


@query("text_logistic")
def text_logistic(spark, sf):
    return training.classify(document_features(spark, sf), models.TextLogistic(), describe=False)["predictions"]


@query("text_svm")
def text_svm(spark, sf):
    return training.classify(document_features(spark, sf), models.TextSVM(), describe=False)["predictions"]


@query("telemetry_forest")
def telemetry_forest(spark, sf):
    _, gpu = user_tables(spark, sf)
    names = feature_columns(gpu)
    return training.classify(fill_features(gpu, names), models.TelemetryForest(numbers=names), describe=False)["predictions"]


def fused(spark, sf, **settings):
    text, gpu = user_tables(spark, sf)
    names = feature_columns(gpu)
    both = fill_features(joins.fuse_features(text, gpu), names, ["text_normalized"])
    return training.classify(both, models.FusedForest(numbers=names, **settings), describe=False)


@query("fused_forest")
def fused_forest(spark, sf):
    return fused(spark, sf)["predictions"]


@query("fused_forest_shrunk")
def fused_forest_shrunk(spark, sf):
    return fused(spark, sf, num_trees=50, max_depth=4, min_leaf=2)["predictions"]


def planted(spark, sf):
    """Labelled documents with a word for the class behind every twenty characters' worth of text."""
    mark = F.when(F.col("label") == LABELS[1], " zetamark").otherwise(" omegamark")
    times = (F.char_length("text_normalized") / 20 + 2).cast("int")
    text = F.concat(F.coalesce("text_normalized", F.lit("")), F.repeat(mark, F.coalesce(times, F.lit(2))))
    return document_features(spark, sf).withColumn("text_normalized", text)


_CLASS = "case when toxic = 1 then 'adversarial' else 'ordinary' end"
_PLANTED = f"select doc_id as episode_id, {_CLASS} as label, {_CLASS} as predicted from documents join labels using (doc_id)"


@query("text_logistic_planted", _PLANTED)
def text_logistic_planted(spark, sf):
    """A word that gives the class away is found in every fold."""
    out = training.classify(planted(spark, sf), models.TextLogistic(), describe=False)["predictions"]
    return out.select("episode_id", "label", "predicted")


@query("text_svm_planted", _PLANTED)
def text_svm_planted(spark, sf):
    out = training.classify(planted(spark, sf), models.TextSVM(), describe=False)["predictions"]
    return out.select("episode_id", "label", "predicted")


@query("top_terms_planted", "select * from (values ('adversarial', 1, 'zetamark'), ('ordinary', 1, 'omegamark')) t(side, rank, term)")
def top_terms_planted(spark, sf):
    """The planted words are the strongest terms of a fit on all labelled documents."""
    estimator = models.TextSVM()
    features = planted(spark, sf)
    fitted = estimator.fit_stacked(materialise(estimator.prepare(features, KEY_FIELDS)))
    return models.top_terms(fitted, features, 1).select("side", "rank", "term")


@query(
    "out_of_fold",
    f"""select doc_id as episode_id, {_CLASS} as label,
              cast((row_number() over (order by {_CLASS}, md5(doc_id || '|0')) - 1) % 5 as integer) as fold,
              {_CLASS} as predicted
       from documents join labels using (doc_id)""",
)
def out_of_fold(spark, sf):
    """Every labelled document is predicted once, by the model of its fold, which finds the planted word."""
    dealt = materialise(stratified_folds(planted(spark, sf)))
    stack = stacked.fit_stack(dealt, stacked.LOGISTIC, folds=5)
    return dealt.select("episode_id", "label").join(stack.predictions(), "episode_id").select(
        "episode_id", "label", "fold", "predicted"
    )


@query("stacked_top_terms_planted", "select * from (values ('adversarial', 1, 'zetamark'), ('ordinary', 1, 'omegamark')) t(side, rank, term)")
def stacked_top_terms_planted(spark, sf):
    """The planted words are the strongest terms of a fit whose coefficients are a table."""
    return stacked.fit_stack(planted(spark, sf), stacked.SQUARED_HINGE).top_terms(1).select("side", "rank", "term")


@query("top_terms")
def top_terms(spark, sf):
    """Strongest terms of a fit on all labelled documents."""
    estimator = models.TextLogistic()
    features = document_features(spark, sf)
    fitted = estimator.fit_stacked(materialise(estimator.prepare(features, KEY_FIELDS)))
    return rounded(models.top_terms(fitted, features), "weight")


@query("top_importances")
def top_importances(spark, sf):
    """Features that a forest on all users relies on most."""
    _, gpu = user_tables(spark, sf)
    names = feature_columns(gpu)
    filled = fill_features(gpu, names)
    fitted = models.TelemetryForest(numbers=names).fit(filled)
    return rounded(models.top_importances(fitted, gpu), "weight")
