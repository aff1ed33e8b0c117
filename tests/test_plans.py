"""The shape of physical plans: what is shuffled, read and run outside the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from jobsignals.operators import ranking, series, terms, totals
from jobsignals.queries import QUERIES
from jobsignals.queries.registry import ORDER, event_series, table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return re.findall(r"Exchange (\w+)", plan)


@pytest.mark.parametrize("name", ["gpu_features", "series_features_cut_series", "counter_delta", "convergence", "text_features", "tfidf", "stratified_folds", "masked_examples"])
def test_no_python_and_no_cross_join(spark, sf, name):
    plan = plan_of(QUERIES[name].run(spark, sf))
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_gpu_features_shuffle_samples_once_and_read_them_once(spark, sf):
    plan = plan_of(QUERIES["gpu_features"].run(spark, sf))
    assert exchanges(plan) == ["hashpartitioning"] and plan.count("FileScan") == 1


def test_slope_shuffles_once(spark, sf):
    assert exchanges(plan_of(series.metric_slope(event_series(spark, sf), order=ORDER))) == ["hashpartitioning"]


def test_statistics_are_combined_before_the_shuffle(spark, sf):
    plan = plan_of(series.metric_stats(event_series(spark, sf)))
    assert "partial_avg" in plan and exchanges(plan) == ["hashpartitioning"]


def test_only_needed_columns_are_read(spark, sf):
    plan = plan_of(series.metric_stats(event_series(spark, sf)))
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan


def test_id_ranges_reach_the_scan(spark, sf):
    plan = plan_of(QUERIES["filter_id_ranges"].run(spark, sf))
    assert "GreaterThanOrEqual(user_id,3)" in plan.split("PushedFilters")[1]


def test_grams_are_counted_where_the_texts_were_dealt(spark, sf):
    plan = plan_of(terms.ngrams(table(spark, sf, "documents"), "doc_id"))
    assert exchanges(plan) == ["hashpartitioning"] and "SortAggregate" not in plan


def test_grams_of_a_task_are_not_held_together(spark, sf):
    plan = plan_of(terms.ngrams(table(spark, sf, "documents"), "doc_id"))
    assert not re.search(r"Aggregate\(keys=\[[^\]]*term", plan) and "Sort " not in plan


def test_tfidf_moves_rows_by_document_and_term_only(spark, sf):
    plan = plan_of(terms.tfidf(table(spark, sf, "documents"), "doc_id"))
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert set(moved) == {"doc_id", "term"} and len(moved) <= 3 and "RoundRobin" not in plan


def test_building_tfidf_runs_no_job(spark, sf):
    docs = table(spark, sf, "documents").withColumn("fold", F.col("doc_id") % 5)
    spark.sparkContext.setJobGroup("build-tfidf", "")
    terms.tfidf(docs, "doc_id")
    terms.tfidf(docs, "doc_id", fold="fold")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("build-tfidf")) == 0
    spark.sparkContext.setJobGroup("", "")


def test_folds_window_only_inside_buckets(spark, sf):
    plan = plan_of(ranking.stratified_folds(table(spark, sf, "labels"), "toxic", "doc_id"))
    for spec in re.findall(r"Window \[row_number.*?\], \[(.*?)\]", plan):
        assert "_bucket" in spec


def test_distinct_addresses_are_spread_before_they_are_counted(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_brand as episode_id", "p_type as remote_addresses")
    plan = plan_of(totals.distinct_destinations(df))
    assert "_address" in re.findall(r"hashpartitioning\(([^)]*)\)", plan)[-1]


