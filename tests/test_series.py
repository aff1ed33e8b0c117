import math
import random

import pytest
from pyspark.sql import functions as F

from jobsignals.operators import joins, series, slicing, totals

HOT = 40  # series longer than this are cut in these tests


def walk(spark, seed=1):
    """Series of very different lengths; one holds most rows, most of them in one second."""
    rng = random.Random(seed)
    rows = []
    for key, n in (("hot", 400), ("long", 90), ("short", 5), ("one", 1)):
        level = 100.0
        for i in range(n):
            level += rng.uniform(-1, 0.6)
            value = None if rng.random() < 0.1 else round(level, 3)
            rows.append((key, float(i // 50 if key == "hot" else i), i, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t double, i long, v double"), rows


def ordered(rows, key):
    return [r[3] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))]


def slope(y):
    n = len(y)
    if n < 2:
        return 0.0
    mx, my = (n - 1) / 2, sum(y) / n
    return sum((x - mx) * (v - my) for x, v in enumerate(y)) / sum((x - mx) ** 2 for x in range(n))


def brute_features(values):
    y = [v for v in values if v is not None]
    if not y:
        return (0.0,) * 5
    mean = sum(y) / len(y)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in y) / len(y)), min(y), max(y), slope(y)


@pytest.mark.parametrize("limit", [HOT, 10**6])
def test_features_equal_brute_force_cut_or_not(spark, limit):
    df, rows = walk(spark)
    got = {r["k"]: r for r in series.series_features(df, ["k"], ["t", "i"], "v", limit).collect()}
    for key in ("hot", "long", "short", "one"):
        want = brute_features(ordered(rows, key))
        if key in got:
            assert [got[key][c] for c in ("mean", "std", "min", "max", "slope")] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("limit", [HOT, 10**6])
def test_wide_features_equal_brute_force_cut_or_not(spark, limit):
    df, rows = walk(spark)
    wide = df.withColumns({"w": F.when(F.col("i") % 3 == 0, F.col("v")), "none": F.lit(None), "error": F.when(F.col("i") % 4 == 0, "x")})
    out = series.gpu_features(wide, ["v", "w", "none"], "k", ["t", "i"], rows_per_series=limit)
    for r in out.collect():
        mine = sorted((x for x in rows if x[0] == r["k"]), key=lambda x: (x[1], x[2]))
        assert r["nvml_sample_count"] == len(mine)
        assert r["nvml_error_rate"] == pytest.approx(sum(x[2] % 4 == 0 for x in mine) / len(mine))
        for m, values in (("v", [x[3] for x in mine]), ("w", [x[3] for x in mine if x[2] % 3 == 0]), ("none", [])):
            got = [r[f"{m}_{s}"] for s in ("mean", "std", "min", "max", "slope")]
            assert got == pytest.approx(brute_features(values), abs=1e-9)


def test_constant_series_has_no_deviation_and_no_slope(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"), F.lit(79543.312).alias("v"))
    for limit in (HOT, 10**6):
        r = series.series_features(df, ["k"], ["t"], "v", limit).first()
        assert (r["std"], r["slope"], r["mean"]) == (0.0, 0.0, 79543.312)


@pytest.mark.parametrize("limit", [HOT, 10**6])
def test_index_and_delta_cross_slices(spark, limit):
    df, rows = walk(spark)
    index = series.sample_index(df, ["k"], ["t", "i"], "v", limit)
    for key in ("hot", "long", "short"):
        got = [(r["sample_index"], r["v"]) for r in index.filter(F.col("k") == key).orderBy("sample_index").collect()]
        assert got == list(enumerate(v for v in ordered(rows, key) if v is not None))
    deltas = series.counter_delta(df, ["k"], ["t", "i"], ["i"], F.lit(-5).cast("long"), limit)
    for r in deltas.collect():
        assert (r["i_delta"], r["i_reset"]) == (1 if r["i"] else 5, False)


@pytest.mark.parametrize("n_series", [1, 2000])
def test_slices_are_even_whatever_the_number_of_long_series(spark, n_series):
    """All rows have one time, so that only the tie-break can cut them."""
    n = 40_000
    df = spark.range(n).select((F.col("id") % n_series).alias("k"), F.lit(1.0).alias("t"), F.col("id").alias("i"))
    limit = 2000 if n_series == 1 else 10
    s = slicing.slice_series(df, ["k"], ["t", "i"], limit)
    sizes = [r["count"] for r in s.df.groupBy(slicing.SLICE).count().collect()]
    assert s.hot and sum(sizes) == n and max(sizes) < 2 * n / len(sizes)
    if n_series == 1:
        assert len(sizes) == 20
    index = series.sample_index(df, ["k"], ["t", "i"], "i", limit)
    assert index.filter(F.col("sample_index") != F.floor(F.col("i") / n_series)).isEmpty()


def test_many_slices_take_few_partitions(spark):
    """Short slices of a long series share partitions, and each still has its rows in order."""
    n = 20_000
    df = spark.range(n).select((F.col("id") % 3).alias("k"), F.lit(1.0).alias("t"), F.col("id").alias("i"))
    s = slicing.slice_series(df, ["k"], ["t", "i"], 20)
    per_slice = s.df.groupBy("k", slicing.SLICE).agg(F.count("i").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert s.df.select(F.input_file_name()).distinct().count() <= slicing.PARTITIONS and len(per_slice) >= n / 20
    assert all(r.n <= 20 and r.b - r.a == 3 * (r.n - 1) for r in per_slice)
    for k in range(3):
        mine = sorted((r[slicing.SLICE], r.a) for r in per_slice if r.k == k)
        assert [a for _, a in mine] == sorted(a for _, a in mine)
    index = series.sample_index(df, ["k"], ["t", "i"], "i", 20)
    assert index.count() == n and index.filter(F.col("sample_index") != F.floor(F.col("i") / 3)).isEmpty()


def test_null_key_is_a_series_of_its_own(spark):
    df = spark.range(200).select(
        F.when(F.col("id") < 150, F.lit(None)).otherwise(F.lit("b")).alias("k"), F.col("id").cast("double").alias("t"),
        F.col("id").alias("v"),
    )
    rows = series.sample_index(df, ["k"], ["t"], "v", HOT).collect()
    assert sorted((r["k"] or "", r["sample_index"]) for r in rows) == [("", i) for i in range(150)] + [("b", i) for i in range(50)]


def test_gaps(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 2.5, 9.0)], "k string, t double")
    rows = series.sample_gaps(df, ["k"], ["t"]).orderBy("t").collect()
    assert [(r["elapsed"], r["is_late"], r["is_gap"]) for r in rows] == [
        (None, False, False), (1.0, False, False), (1.5, True, False), (6.5, True, True),
    ]


def brute_convergence(values, patience, delta, min_steps):
    best, at, since, step = float("inf"), 0, 0, 0
    for step, v in enumerate(values, 1):
        if v is not None and v < best - delta:
            best, at, since = v, step, 0
        else:
            since += 1
        if step >= min_steps and since >= patience:
            return best, at, True, step
    return best, at, False, step


@pytest.mark.parametrize("limit", [HOT, 10**6])
@pytest.mark.parametrize("patience, delta, min_steps", [(5, 0.01, 5), (12, 0.5, 30), (1, 0.0, 1), (4, 0, 9), (60, 2.0, 3)])
def test_convergence_equals_brute_force(spark, limit, patience, delta, min_steps):
    df, rows = walk(spark, 3)
    out = series.convergence(df, ["k"], ["t", "i"], "v", patience, delta, min_steps, limit)
    got = {r["k"]: (r["best_value"] if r["best_step"] else float("inf"), r["best_step"], r["converged"], r["last_step"]) for r in out.collect()}
    assert got == {k: brute_convergence(ordered(rows, k), patience, delta, min_steps) for k in ("hot", "long", "short", "one")}


@pytest.mark.parametrize("delta", [0, 0.25])
@pytest.mark.parametrize("limit", [3, 10**6])
def test_convergence_with_values_that_are_no_numbers(spark, limit, delta):
    nan, inf = float("nan"), float("inf")
    lists = {"a": [nan, inf, 5.0, nan, 4.0], "b": [None] * 9 + [1.0], "c": [nan, inf, None], "d": [inf, 3.0, 3.0, 3.0, 2.0, -inf, -inf, nan]}
    df = spark.createDataFrame([(k, i, v) for k, vs in lists.items() for i, v in enumerate(vs)], "k string, t long, v double")
    out = series.convergence(df, ["k"], ["t"], "v", 3, delta, 4, limit)
    got = {r["k"]: (r["best_value"] if r["best_step"] else inf, r["best_step"], r["converged"], r["last_step"]) for r in out.collect()}
    assert got == {k: brute_convergence(vs, 3, delta, 4) for k, vs in lists.items()}


def test_convergence_without_a_margin_gathers_nothing(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("t"), (-F.col("id")).cast("double").alias("v"))
    plan = series.convergence(df, ["k"], ["t"], "v", min_delta=0)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hash") <= 1


def test_falling_series_never_converges(spark):
    df = spark.range(300).select(F.lit("a").alias("k"), F.col("id").alias("t"), (-F.col("id")).cast("double").alias("v"))
    for limit in (HOT, 10**6):
        r = series.convergence(df, ["k"], ["t"], "v", rows_per_series=limit).first()
        assert (r["converged"], r["best_step"], r["last_step"]) == (False, 300, 300)


def test_records_of_a_stalled_series_are_not_gathered(spark):
    """A slow fall makes every step a record, but the series is over after a few steps."""
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (-F.col("id") / 1000.0).alias("v"))
    for limit in (HOT, 10**6):
        r = series.convergence(df, ["k"], ["t"], "v", rows_per_series=limit).first()
        assert (r["converged"], r["best_step"], r["last_step"], r["n_steps"]) == (True, 1, 6, 5000)


def test_summary_equals_its_two_parts(spark):
    df = spark.createDataFrame(
        [("a", "1", "2", "x;y;z"), ("a", "<error>", "4", "y"), ("a", "8", "16", ""), ("b", "1", None, None)],
        "episode_id string, bytes_sent_delta string, bytes_recv_delta string, remote_addresses string",
    )
    whole = totals.network_summary(df)
    parts = totals.network_totals(df).join(totals.distinct_destinations(df), "episode_id")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select(whole.columns).collect())) == [
        ("a", 9, 22, 3), ("b", 1, 0, 0),
    ]


def test_totals(spark):
    df = spark.createDataFrame(
        [("a", 1, "10"), ("a", 1, "30"), ("a", 2, "<error: X>"), ("a", None, "999"), ("b", 1, None)],
        "episode_id string, pid int, read_bytes string",
    )
    out = {r[0]: r[1] for r in totals.counter_totals(df, columns=["read_bytes"]).collect()}
    assert out == {"a": 30, "b": 0}
    lists = spark.createDataFrame([("a", "x;y"), ("a", "y;"), ("b", "")], "episode_id string, remote_addresses string")
    assert {r[0]: r[1] for r in totals.distinct_destinations(lists).collect()} == {"a": 2, "b": 0}
    assert {r[0]: r[1] for r in totals.distinct_destinations(lists, approximate=True).collect()} == {"a": 2, "b": 0}


def test_scoped_connections(spark):
    conns = spark.createDataFrame(
        [("a", 1, 7, "z:1", "ESTABLISHED"), ("a", 1, 7, "b:1", "ESTABLISHED"), ("a", 1, 7, "b:1", "ESTABLISHED"),
         ("a", 1, 8, "own:not", "ESTABLISHED"), ("a", 1, 7, "c:1", "LISTEN"), ("a", 2, 7, "late:1", "ESTABLISHED")],
        "episode_id string, timestamp long, pid long, address string, status string",
    )
    procs = spark.createDataFrame([("a", 1, 7), ("a", 1, 7)], "episode_id string, timestamp long, pid long")
    out = joins.address_lists(joins.scope_connections(conns, procs))
    assert [tuple(r) for r in out.collect()] == [("a", 1, "b:1;z:1")]
