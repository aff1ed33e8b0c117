"""Joins of feature tables, scores of predictions, comparison, result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LABELS, METRICS
from ..operators import cohort, joins, metrics
from ..plans.comparison import comparison_report
from ..plans.training import answered
from ..session import fresh_path
from ..sources.tables import load_features, write_processed, write_results
from .registry import query, rounded, table

# Three stand-in classifiers over the labelled documents. The third leaves some unparsed.
_GUESSES = {
    "text": ("quality = 0", None),
    "nvml": ("n_chars > 500", None),
    "api_baseline": ("n_chars % 3 = 0", "n_chars % 5 = 0"),
}


def _guess(name: str):
    said, unparsed = _GUESSES[name]
    named = F.when(F.expr(said), LABELS[1]).otherwise(LABELS[0])
    return F.when(F.expr(unparsed), "<unparsed: 'maybe'>").otherwise(named) if unparsed else named


def _guess_sql(name: str) -> str:
    said, unparsed = _GUESSES[name]
    first = f"when {unparsed} then '<unparsed: ''maybe''>' " if unparsed else ""
    return f"case {first}when {said} then 'adversarial' else 'ordinary' end"


_PRED = "pred as (select * from (" + " union all ".join(
    f"""select '{n}' as classifier, doc_id as episode_id, lang as family, case when toxic = 1 then 'adversarial' else 'ordinary' end as label,
        {_guess_sql(n)} as predicted from documents join labels using (doc_id)"""
    for n in _GUESSES
) + "))"
_COUNTS = """counts as (select classifier, count(*) as n, count(*) filter (where predicted in ('ordinary', 'adversarial')) as n_valid,
  count(*) filter (where label = 'adversarial' and predicted = 'adversarial') as tp,
  count(*) filter (where label = 'ordinary' and predicted = 'adversarial') as fp,
  count(*) filter (where label = 'adversarial' and predicted = 'ordinary') as fn_valid,
  count(*) filter (where label = 'adversarial' and predicted <> 'adversarial') as fn,
  count(*) filter (where label = predicted) as hits from pred group by classifier)"""


def _scores_sql(fn: str, n: str) -> str:
    p, r = "coalesce(tp / nullif(tp + fp, 0), 0)", f"coalesce(tp / nullif(tp + {fn}, 0), 0)"
    return f"""round(hits / {n}, 6) as accuracy, round({p}, 6) as precision, round({r}, 6) as recall,
               round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 6) as f1"""


def labelled(spark, sf):
    return joins.fuse_features(
        table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", ["doc_id"]
    )


def guesses(spark, sf):
    """Predictions of the three stand-ins, one row per classifier and document."""
    label = F.when(F.col("toxic") == 1, LABELS[1]).otherwise(LABELS[0]).alias("label")
    named = [F.struct(F.lit(n).alias("classifier"), _guess(n).alias("predicted")) for n in _GUESSES]
    every = labelled(spark, sf).select("doc_id", "lang", label, F.inline(F.array(*named)))
    return metrics.predictions(every, "doc_id", "lang", keep=["classifier"])


@query(
    "fuse_features",
    "select doc_id, text, lang, quality, toxic from documents join labels using (doc_id)",
)
def fuse(spark, sf):
    return labelled(spark, sf).select("doc_id", "text", "lang", "quality", "toxic")


@query(
    "reconcile",
    """select (select count(*) from documents) as left_rows, (select count(*) from labels) as right_rows,
              (select count(*) from documents join labels using (doc_id)) as joined_rows,
              (select count(distinct doc_id) from documents where doc_id not in (select doc_id from labels)) as left_only,
              (select count(distinct doc_id) from labels where doc_id not in (select doc_id from documents)) as right_only""",
)
def reconciled(spark, sf):
    return joins.reconcile(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "lost_keys",
    """select doc_id, 'left' as side from documents where doc_id not in (select doc_id from labels)
       union all select doc_id, 'right' from labels where doc_id not in (select doc_id from documents)""",
)
def lost(spark, sf):
    return joins.lost_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "predictions",
    f"with {_PRED} select classifier, episode_id, family as scenario_family, label, predicted, label = predicted as correct from pred",
)
def predicted(spark, sf):
    return guesses(spark, sf)


@query("valid_predictions", f"with {_PRED} select classifier, episode_id from pred where predicted in ('ordinary', 'adversarial')")
def valid(spark, sf):
    return cohort.valid_predictions(guesses(spark, sf)).select("classifier", "episode_id")


@query("binary_metrics", f"with {_PRED}, {_COUNTS} select classifier, n, {_scores_sql('fn', 'n')} from counts")
def scores(spark, sf):
    out = metrics.binary_metrics(guesses(spark, sf), by=["classifier"])
    return rounded(out, *METRICS)


@query("valid_only_metrics", f"with {_PRED}, {_COUNTS} select classifier, n, n_valid, {_scores_sql('fn_valid', 'n_valid')} from counts")
def valid_scores(spark, sf):
    out = metrics.valid_only_metrics(guesses(spark, sf), by=["classifier"])
    return rounded(out, *METRICS)


@query(
    "confusion_matrix",
    f"""with {_PRED}, cells as (
          select c.classifier, a.label, b.label as predicted, 2 * a.i + b.i as position
          from (select distinct classifier from pred) c, (values ('ordinary', 0), ('adversarial', 1)) a(label, i),
               (values ('ordinary', 0), ('adversarial', 1)) b(label, i))
        select cells.classifier, position, cells.label, cells.predicted, count(episode_id) as count
        from cells left join pred on pred.classifier = cells.classifier and pred.label = cells.label and pred.predicted = cells.predicted
        group by all""",
)
def confusion(spark, sf):
    return metrics.confusion_matrix(guesses(spark, sf), by=["classifier"])


@query("family_accuracy", f"with {_PRED} select classifier, family, count(*) as n, round(avg(case when label = predicted then 1 else 0 end), 6) as accuracy from pred group by all")
def families(spark, sf):
    return rounded(metrics.family_accuracy(guesses(spark, sf), by=["classifier"]), "accuracy")


_COMPARED = ("text", "nvml", "combined", "api_baseline")
_COMPARE_SQL = ", ".join(
    f"round(avg(case when label = predicted then 1 else 0 end) filter (where classifier = '{c}'), 6) as {c}" for c in _COMPARED
)


@query("compare", f"with {_PRED} select family, {_COMPARE_SQL} from pred group by family")
def compared(spark, sf):
    """One of the four classifiers has no results; its column is null."""
    accuracy = metrics.family_accuracy(guesses(spark, sf), by=["classifier"])
    return rounded(metrics.compare(accuracy, _COMPARED), *_COMPARED)


@query(
    "chart_scores",
    f"""with {_PRED}, {_COUNTS}, scores as (select classifier, {_scores_sql('fn', 'n')} from counts)
        select classifier, metric, value from (
          {" union all ".join(f"select classifier, '{m}' as metric, {m} as value from scores" for m in METRICS)})""",
)
def score_bars(spark, sf):
    pred = guesses(spark, sf)
    comparison = metrics.compare(metrics.family_accuracy(pred, by=["classifier"]), _COMPARED)
    bars, _ = metrics.chart_data(metrics.binary_metrics(pred, by=["classifier"]), comparison)
    return rounded(bars, "value")


@query(
    "chart_families",
    f"""with {_PRED}, wide as (select family, {_COMPARE_SQL} from pred group by family)
        {" union all ".join(f"select family, '{c}' as classifier, coalesce({c}, 0) as accuracy from wide" for c in _COMPARED)}""",
)
def family_bars(spark, sf):
    pred = guesses(spark, sf)
    comparison = metrics.compare(metrics.family_accuracy(pred, by=["classifier"]), _COMPARED)
    _, bars = metrics.chart_data(metrics.binary_metrics(pred, by=["classifier"]), comparison)
    return rounded(bars, "accuracy")


@query(
    "comparison_report",
    f"with {_PRED} select family, {_COMPARE_SQL} from pred group by family",
)
def report(spark, sf):
    """Results of each stand-in written, written again, and compared from what is on disk."""
    out = fresh_path(spark, "results")
    pred = guesses(spark, sf)
    for name in ("text", "nvml", "api_baseline", "text"):
        one = pred.filter(F.col("classifier") == name).drop("classifier")
        write_results(
            name, out, predictions=one, metrics=metrics.binary_metrics(one), families=metrics.family_accuracy(one)
        )
    tables, missing = comparison_report(spark, out, _COMPARED)
    wide = tables["per_family_accuracy"].withColumns({c: F.lit(None).cast("double") for c in missing})
    return rounded(wide, *_COMPARED)


@query(
    "processed_tables",
    "select doc_id as episode_id, coalesce(case when lang <> 'de' then text end, '') as text, lang from documents",
)
def processed(spark, sf):
    """Written twice over, then loaded for training with missing text filled."""
    out = fresh_path(spark, "processed")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), "lang", "text")
    write_processed({"text_features": d}, out)
    write_processed({"text_features": d.withColumn("text", F.when(F.col("lang") != "de", F.col("text")))}, out)
    return load_features(spark, out, "text_features", ["text"])


@query(
    "answered",
    """with turns as (select conv_id, max(text) filter (where turn = 1) as answer from conversations group by conv_id),
       pred as (select case when d.doc_id % 4 = 0 then 'adversarial' else 'ordinary' end as label,
                       case when lower(answer) like '%adversarial%' or doc_id % 3 = 0 then 'adversarial' when doc_id % 3 = 1 then 'ordinary' else '<unparsed>' end as predicted
                from documents d left join turns on d.doc_id = turns.conv_id where true),
       c as (select count(*) as n, count(*) filter (where predicted <> '<unparsed>') as n_valid,
                    count(*) filter (where label = 'adversarial' and predicted = 'adversarial') as tp,
                    count(*) filter (where label = 'ordinary' and predicted = 'adversarial') as fp,
                    count(*) filter (where label = 'adversarial' and predicted = 'ordinary') as fn_valid,
                    count(*) filter (where label = predicted) as hits from pred)
       select n, n_valid, """ + _scores_sql("fn_valid", "n_valid") + " from c",
)
def zero_shot(spark, sf):
    """Free answers to one question per document; every third one names no label."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("episode_id"),
        F.when(F.col("doc_id") % 4 == 0, LABELS[1]).otherwise(LABELS[0]).alias("label"),
        F.col("lang").alias("scenario_family"),
    )
    turn = table(spark, sf, "conversations").filter("turn = 1").select(F.col("conv_id").alias("episode_id"), "text")
    said = (
        F.when(F.col("episode_id") % 3 == 0, "I say adversarial. ")
        .when(F.col("episode_id") % 3 == 1, "Ordinary! ")
        .otherwise("")
    )
    answers = d.join(turn, "episode_id", "left").select(
        "episode_id", F.concat(said, F.coalesce("text", F.lit(""))).alias("answer")
    )
    return rounded(answered(d, answers)["metrics"], *METRICS)
