from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobsignals.functions.ids import pad_id
from jobsignals.operators import cohort, examples, joins, metrics, ranking


def ids(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("episode_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("label"))


@pytest.mark.parametrize("n, k", [(10, 5), (103, 5), (64, 3)])
def test_folds_share_rows_and_classes_evenly(spark, n, k):
    dealt = ranking.stratified_folds(ids(spark, n), k=k, seed=4)
    rows = dealt.collect()
    assert sorted(int(r.episode_id) for r in rows) == list(range(n))
    for keep in ("a", "b", None):
        sizes = [sum(1 for r in rows if r.fold == f and keep in (None, r.label)) for f in range(k)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_depend_on_seed_only(spark):
    df = ids(spark, 60)
    one, again, other = (
        {r.episode_id: r.fold for r in ranking.stratified_folds(d, seed=s).collect()}
        for d, s in ((df, 1), (df.repartition(7), 1), (df, 2))
    )
    assert one == again and one != other


def test_rows_without_label_stay(spark):
    df = spark.range(20).select(F.col("id").alias("episode_id"), F.lit(None).cast("string").alias("label"))
    assert ranking.stratified_folds(df).count() == 20


def test_plan_is_balanced_and_numbered(spark):
    families = spark.createDataFrame([(f,) for f in "cab"], "scenario_family string")
    rows = ranking.assignment_plan(families, 11, 4, seed=2, first_id=998).orderBy("position").collect()
    assert [r.episode_id for r in rows] == ["998", "999"] + [str(i) for i in range(1000, 1009)]
    assert [r.seed for r in rows] == list(range(997, 1008)) and [r.gpu_index for r in rows] == [i % 4 for i in range(11)]
    counts = {f: sum(r.scenario_family == f for r in rows) for f in "abc"}
    assert counts == {"a": 4, "b": 4, "c": 3}
    other = ranking.assignment_plan(families, 11, 4, order=("c", "a")).groupBy("scenario_family").count()
    assert dict(map(tuple, other.collect())) == {"c": 4, "a": 4, "b": 3}
    assert [r.scenario_family for r in rows] != sorted(r.scenario_family for r in rows)
    with pytest.raises(ValueError):
        ranking.assignment_plan(families, 2, 4)


def test_styles_are_drawn_evenly_and_apart(spark):
    families = spark.createDataFrame([("ordinary_a",), ("adversarial_b",)], "scenario_family string")
    plan = ranking.styled_plan(ranking.assignment_plan(families, 1800, 4, seed=2), seed=3)
    pairs = Counter((r.invocation_style, r.workdir_style) for r in plan.collect())
    assert len(pairs) == 9 and all(140 < n < 260 for n in pairs.values())
    assert {(r.scenario_family, r.label) for r in plan.collect()} == {("ordinary_a", "ordinary"), ("adversarial_b", "adversarial")}
    odd = spark.createDataFrame([("001", "c")], "episode_id string, scenario_family string")
    with pytest.raises(Exception, match="no label"):
        ranking.styled_plan(odd).collect()
    assert ranking.styled_plan(odd, F.lit("x"), styles={"s": ["only"]}).first()["s"] == "only"


def test_samples(spark):
    df = ids(spark, 500)
    sample = ranking.sample_where(df, F.col("label") == "b", 30, 9)
    first = df.filter(F.col("label") == "b").orderBy(ranking.shuffle_key("episode_id", 9)).limit(30)
    assert {r.episode_id for r in sample.collect()} == {r.episode_id for r in first.collect()} and sample.count() == 30
    assert ranking.sample_where(df, F.col("label") == "b", 10_000, 9).count() == 167
    with pytest.raises(ValueError):
        ranking.sample_where(df, F.col("label") == "c", 1)


def test_many_ranges(spark):
    df = spark.range(2000).select("id", pad_id("id").alias("episode_id"))
    spec = ",".join(f"{i}-{i + 3}" for i in range(0, 1500, 10))
    want = [i for i in range(1504) if i % 10 < 4 and i < 1494]
    for column in ("id", "episode_id"):
        got = cohort.filter_id_ranges(df, column, spec)
        assert sorted(r.id for r in got.collect()) == want and got.columns == df.columns
        many = ",".join(str(2 * i) for i in range(10_000)) + ",30000-4000000000"
        assert cohort.filter_id_ranges(df, column, many).count() == 1000
    assert cohort.filter_id_ranges(df, "id", ",").count() == 0
    assert cohort.filter_id_ranges(df, "id", "").count() == 2000
    assert cohort.filter_id_ranges(spark.createDataFrame([("61",), ("061",)], "e string"), "e", "60-62").collect()[0].e == "061"


def test_next_id(spark):
    df = spark.createDataFrame([("009",), ("120x",), ("041",), (None,)], "episode_id string")
    assert cohort.next_id(df).first()[0] == 42
    assert cohort.next_id(df.filter("false")).first()[0] == 1


def test_too_few_rows(spark):
    assert cohort.require_rows(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        cohort.require_rows(spark.range(4), 5)


def test_reconcile_counts_both_sides(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("b",), ("c",), (None,)], "k string")
    assert joins.reconcile(left, right, "k").first().asDict() == {
        "left_rows": 4, "right_rows": 3, "joined_rows": 2, "left_only": 1, "right_only": 1,
    }
    assert sorted(tuple(r) for r in joins.lost_keys(left, right, "k").collect()) == [("a", "left"), ("c", "right")]


def matrix(spark, cells):
    rows = [(a, p) for a, p, n in cells for _ in range(n)]
    return spark.createDataFrame(
        [(str(i), "f", a, p, a == p) for i, (a, p) in enumerate(rows)],
        "episode_id string, scenario_family string, label string, predicted string, correct boolean",
    )


def test_published_confusion_matrix_gives_published_scores(spark):
    o, a = "ordinary", "adversarial"
    pred = matrix(spark, [(o, o, 12), (o, a, 3), (a, o, 10), (a, a, 5)])
    row = metrics.binary_metrics(pred).first()
    assert (row.accuracy, row.precision, row.recall) == pytest.approx((17 / 30, 0.625, 1 / 3))
    assert row.f1 == pytest.approx(0.43478260869565216)
    cells = {(r.label, r.predicted): r["count"] for r in metrics.confusion_matrix(pred).collect()}
    assert cells == {(o, o): 12, (o, a): 3, (a, o): 10, (a, a): 5}


def test_undefined_ratios_are_zero_and_empty_cells_present(spark):
    pred = matrix(spark, [("adversarial", "ordinary", 2)])
    row = metrics.binary_metrics(pred).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0, 0.0)
    assert sorted(r["count"] for r in metrics.confusion_matrix(pred).collect()) == [0, 0, 0, 2]


def test_unparsed_answers_count_for_families_only(spark):
    pred = matrix(spark, [("adversarial", "adversarial", 1), ("ordinary", "<unparsed: 'x'>", 1)])
    row = metrics.valid_only_metrics(pred).first()
    assert (row.n, row.n_valid, row.accuracy, row.f1) == (2, 1, 1.0, 1.0)
    assert metrics.family_accuracy(pred).first().accuracy == 0.5
    none = metrics.valid_only_metrics(matrix(spark, [("ordinary", "<unparsed: ''>", 3)])).first()
    assert (none.accuracy, none.precision) == (None, 0.0)


def test_missing_classifier_is_null_then_zero_in_charts(spark):
    rows = [("text", "f", 0.5), ("nvml", "g", 1.0)]
    families = spark.createDataFrame(rows, "classifier string, family string, accuracy double")
    wide = metrics.compare(families, ["text", "nvml"])
    assert [tuple(r) for r in wide.collect()] == [("f", 0.5, None), ("g", None, 1.0)]
    scores = spark.createDataFrame([("text", 0.5, 0.1, 0.2, None)], "classifier string, accuracy double, precision double, recall double, f1 double")
    bars, groups = metrics.chart_data(scores, wide)
    assert {r.metric: r.value for r in bars.collect()} == {"accuracy": 0.5, "precision": 0.1, "recall": 0.2, "f1": 0.0}
    assert {(r.family, r.classifier): r.accuracy for r in groups.collect()}[("f", "nvml")] == 0.0


def test_masked_examples(spark):
    pairs = spark.createDataFrame([(str(i), list(range(10, 10 + i)), [5] * (1 + i % 3)) for i in range(7)], "pair_id string, prompt_ids array<bigint>, response_ids array<bigint>")
    rows = examples.masked_examples(pairs, max_prompt=4, max_response=2, batch_size=3).collect()
    assert sorted(len([r for r in rows if r.batch == b]) for b in range(3)) == [1, 3, 3]
    for r in rows:
        i = int(r.pair_id)
        prompt, response = list(range(10, 10 + min(i, 4))), [5] * min(1 + i % 3, 2) + [1]
        pad = len(r.input_ids) - len(prompt) - len(response)
        assert r.input_ids == prompt + response + [0] * pad
        assert r.labels == [-100] * len(prompt) + response + [-100] * pad
        assert r.attention_mask == [1] * (len(prompt) + len(response)) + [0] * pad
        assert len(r.input_ids) == max(len(x.input_ids) for x in rows if x.batch == r.batch)
    assert any(0 not in r.attention_mask for r in rows)
