"""Statistics, slopes, deltas, gaps and convergence of sampled series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GPU_METRICS, MIN_DELTA, MIN_STEPS, PATIENCE, STATS
from .slicing import ROWS_PER_SERIES, SLICE, Sliced, join_carried, slice_series

ALL_EARLIER = (Window.unboundedPreceding, -1)


def has_error(error: Column | str) -> Column:
    return F.coalesce(F.col(error) if isinstance(error, str) else error, F.lit("")) != ""


def sample_quality(samples: DataFrame, key: str = "episode_id", error: str = "error") -> DataFrame:
    """Rows per episode and the share of them that carry an error."""
    return samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(has_error(error).cast("int")).alias("error_rate"),
    )


def metric_stats(long: DataFrame, keys: Sequence[str] = ("episode_id", "metric"), value: str = "value") -> DataFrame:
    """Mean, population deviation, minimum and maximum of each series; 0.0 without values.

    Partial aggregates are made before the shuffle, so a series of any length costs one row
    per map task.
    """
    stats = {"mean": F.avg(value), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value)}
    return long.groupBy(*keys).agg(
        F.count(value).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in stats.items()]
    )


def sample_index(
    long: DataFrame,
    keys: Sequence[str] = ("episode_id", "metric"),
    order: Sequence[str] = ("timestamp",),
    value: str = "value",
    rows_per_series: int = ROWS_PER_SERIES,
) -> DataFrame:
    """Position of each non-null value in its series, from 0."""
    s = slice_series(long.filter(F.col(value).isNotNull()), keys, order, rows_per_series)
    return indexed(s).df.drop(SLICE)


def indexed(s: Sliced, name: str = "sample_index") -> Sliced:
    """Add the position of each row in its series, from 0."""
    rank = (F.row_number().over(s.window()) - 1).cast("bigint")
    if not s.hot:
        return s.with_df(s.df.withColumn(name, rank))
    ranked = s.with_df(s.df.withColumn(name, rank))
    rows = join_carried(ranked, {"_offset": (F.count(F.lit(1)), F.sum)})
    return s.with_df(rows.withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_offset"))


def _partials(index: str, value: str) -> list[Column]:
    """Counts, means and centred sums of one slice; they add up without cancellation."""
    n = F.count(value)
    return [
        n.alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * n).alias("m2"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.covar_pop(F.col(index).cast("double"), F.col(value)) * n).alias("cross"),
    ]


def _slope(cross: Column, n: Column) -> Column:
    """Least-squares slope on 0..n-1, whose centred sum of squares is n(n^2-1)/12."""
    spread = n * (n * n - 1.0) / 12.0
    return F.when(n > 1, cross / F.when(spread > 0, spread)).otherwise(F.lit(0.0))


def _merge(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine the slices of each series; one row per slice that a series has rows in."""
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(SLICE).rowsBetween(*ALL_EARLIER)
    n = F.col("n").cast("double")
    based = partials.withColumn("_base", F.min("mean").over(whole))
    placed = based.select(
        "*",
        F.sum(n).over(whole).alias("_total"),
        F.sum(n * (F.col("mean") - F.col("_base"))).over(whole).alias("_above"),
        (F.coalesce(F.sum(n).over(earlier), F.lit(0.0)) + (n - 1) / 2.0).alias("_centre"),
    ).withColumn("_mean", F.col("_base") + F.try_divide("_above", "_total"))
    from_mean = F.col("mean") - F.col("_mean")
    from_centre = F.col("_centre") - (F.col("_total") - 1) / 2.0
    return placed.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + n * from_mean * from_mean).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum(F.col("cross") + n * from_mean * from_centre).alias("cross"),
    )


def _finish(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics from the sums of a whole series; a constant one has exactly no spread."""
    n = F.col("n").cast("double")
    zero = F.lit(0.0)
    constant = F.col("min") == F.col("max")
    return partials.select(
        *keys,
        "n",
        F.coalesce(F.when(constant, F.col("min")).otherwise(F.col("mean")), zero).alias("mean"),
        F.coalesce(F.when(~constant, F.sqrt(F.try_divide("m2", n))), zero).alias("std"),
        F.coalesce("min", zero).alias("min"),
        F.coalesce("max", zero).alias("max"),
        F.coalesce(F.when(~constant, _slope(F.col("cross"), n)), zero).alias("slope"),
    )


def series_features(
    long: DataFrame,
    keys: Sequence[str] = ("episode_id", "metric"),
    order: Sequence[str] = ("timestamp",),
    value: str = "value",
    rows_per_series: int = ROWS_PER_SERIES,
) -> DataFrame:
    """The five statistics of each series in long form, one row per series.

    One shuffle by series: the window that numbers the values and the aggregate share it. A job
    that counts the rows of each series comes first.
    """
    s = slice_series(long.filter(F.col(value).isNotNull()), keys, order, rows_per_series)
    numbered = s.df.withColumn("_index", F.row_number().over(s.window()))
    partials = numbered.groupBy(*s.group).agg(*_partials("_index", value))
    return _finish(_merge(partials, s.keys) if s.hot else partials, s.keys)


def metric_slope(
    long: DataFrame,
    keys: Sequence[str] = ("episode_id", "metric"),
    order: Sequence[str] = ("timestamp",),
    value: str = "value",
    rows_per_series: int = ROWS_PER_SERIES,
) -> DataFrame:
    """Least-squares slope of the value on its position in the series; 0.0 for one value."""
    return series_features(long, keys, order, value, rows_per_series).select(*keys, "slope")


def gpu_features(
    samples: DataFrame,
    metrics: Sequence[str] = GPU_METRICS,
    key: str = "episode_id",
    order: Sequence[str] = ("timestamp", "gpu_uuid"),
    error: str = "error",
    prefix: str = "nvml",
    is_sample: str | None = None,
    rows_per_series: int = ROWS_PER_SERIES,
) -> DataFrame:
    """Wide feature row per episode: sample count, error rate and five statistics per metric.

    Rows where ``is_sample`` is false only say that the episode has a log; an episode with no
    other rows gets zeros. Samples are shuffled once, in wide form, by episode. Each metric gets its own running
    count, because positions skip missing values; the metrics are then stacked inside the same
    partitions and aggregated there. ``error`` and the row count ride along as one more metric.
    """
    failed = has_error(error).cast("double")
    samples = samples.select(
        key, *order, *[F.col(m).cast("double").alias(m) for m in metrics],
        (failed if is_sample is None else F.when(F.col(is_sample), failed)).alias("_error"),
    )
    s = slice_series(samples, (key,), order, rows_per_series)
    running = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = (*metrics, "_error")
    numbered = s.df.select("*", *[F.count(m).over(running).alias(f"_i_{m}") for m in names])
    stacked = numbered.select(
        *s.group,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"),
                             (F.col(f"_i_{m}") - 1).cast("double").alias("_index"))
                    for m in names
                ]
            )
        ),
    )
    group = (*s.group, "metric")
    partials = stacked.groupBy(*group).agg(*_partials("_index", "value"))
    keys = (key, "metric")
    stats = _finish(_merge(partials, keys) if s.hot else partials, keys)
    wide = stats.groupBy(key).pivot("metric", list(names)).agg(
        F.first("n").alias("n"), *[F.first(c).alias(c) for c in STATS]
    )
    return wide.select(
        key,
        F.col("_error_n").alias(f"{prefix}_sample_count"),
        F.col("_error_mean").alias(f"{prefix}_error_rate"),
        *[F.col(f"{m}_{c}") for m in metrics for c in STATS],
    )


def previous(s: Sliced, names: Sequence[str], prefix: str = "_prev_") -> Sliced:
    """Add each column's value in the row before, null in the first row of a series."""
    row = F.struct(*names)
    out = s.df.withColumn("_before", F.lag(row).over(s.window()))
    if s.hot:
        tail = F.max_by(row, F.struct(*s.order))
        out = join_carried(
            s.with_df(out), {"_tail": (tail, lambda c: F.last(c, ignorenulls=True))}
        )
        out = out.withColumn("_before", F.coalesce("_before", "_tail")).drop("_tail")
    return s.with_df(out.select("*", *[F.col(f"_before.{n}").alias(prefix + n) for n in names]).drop("_before"))


def counter_delta(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    counters: Sequence[str],
    start: Column | None = None,
    rows_per_series: int = ROWS_PER_SERIES,
) -> DataFrame:
    """Increase of each counter since the row before.

    The first row is compared with ``start`` (null leaves its delta null). A counter that went
    down keeps its negative delta and is marked in ``<counter>_reset``.
    """
    out = previous(slice_series(df, keys, order, rows_per_series), counters).df
    for c in counters:
        before = F.col(f"_prev_{c}")
        if start is not None:
            before = F.coalesce(before, start)
        delta = F.col(c) - before
        out = out.withColumn(f"{c}_delta", delta).withColumn(f"{c}_reset", F.coalesce(delta < 0, F.lit(False)))
    return out.drop(SLICE, *[f"_prev_{c}" for c in counters])


def sample_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    interval: float = 1.0,
    factor: float = 2.0,
    rows_per_series: int = ROWS_PER_SERIES,
) -> DataFrame:
    """Seconds since the tick before, marked as late past one interval and as a gap past
    ``factor`` intervals. ``order[0]`` holds seconds."""
    ts = order[0]
    out = previous(slice_series(df, keys, order, rows_per_series), [ts]).df
    elapsed = F.col(ts) - F.col(f"_prev_{ts}")
    return (
        out.withColumn("elapsed", elapsed)
        .withColumn("is_late", F.coalesce(elapsed > interval, F.lit(False)))
        .withColumn("is_gap", F.coalesce(elapsed > interval * factor, F.lit(False)))
        .drop(SLICE, f"_prev_{ts}")
    )


def convergence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    patience: int = PATIENCE,
    min_delta: float = MIN_DELTA,
    min_steps: int = MIN_STEPS,
    rows_per_series: int = ROWS_PER_SERIES,
) -> DataFrame:
    """Where each series stops improving.

    A step improves when its value is more than ``min_delta`` below the best so far. The series
    has converged at the first step, ``min_steps`` or later, with no improvement in the last
    ``patience`` steps.

    Only record lows matter, as a step that improves is below everything before it. With a
    ``min_delta`` of 0 every record improves, so windows per slice give each record the one before
    it, and the first record that comes too late ends the series: nothing is gathered. Otherwise
    records are looked at one after the other. Windows also find where a series must be over:
    each run of ``patience`` steps of a live series has an improvement, so its low falls by
    more than ``min_delta`` within any 2 * ``patience`` steps. Records from there on are left
    out, so what is gathered of a slice has at most 2 * ``patience`` steps per ``min_delta`` of
    its value range. A counting job, then one scan and one shuffle if no series is cut.
    """
    s = indexed(slice_series(df, keys, order, rows_per_series), "_step")
    below = s.df.withColumn("_step", F.col("_step") + 1).withColumn(
        "_low", F.min(value).over(s.window().rowsBetween(*ALL_EARLIER))
    )
    if s.hot:
        below = join_carried(s.with_df(below), {"_low_before": (F.min(value), F.min)})
        below = below.withColumn("_low", F.least("_low", "_low_before")).drop("_low_before")
    number = F.col(value).cast("double")
    is_record = (number < float("inf")) & (F.col("_low").isNull() | (F.col(value) < F.col("_low")))

    def stop_after(at: Column) -> Column:
        return F.greatest(at + patience, F.lit(min_steps).cast("bigint"))

    if min_delta == 0:
        at_best = _last_in_time(s.with_df(below.withColumn("_record", F.when(is_record, F.col("_step")))), value, stop_after)
        return _stopped(at_best, keys, stop_after)

    span = 2 * patience
    below = below.withColumn("_now", F.least("_low", value))
    fell = F.col("_now") < F.lag("_now", span).over(s.window()) - min_delta
    over = F.coalesce(~fell & (F.col("_step") > min_steps + span), F.lit(False))
    up_to_here = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = below.withColumn("_over", over).withColumn("_ended", F.max("_over").over(up_to_here))

    record = F.struct("_step", number.alias("_value"))
    gathered = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.min(F.when(F.col("_over"), F.col("_step"))).alias("_end"),
        F.array_sort(F.collect_list(F.when(is_record & ~F.col("_ended"), record))).alias("_records"),
    )
    live = F.filter("_records", lambda r: F.col("_end").isNull() | (r["_step"] < F.col("_end")))
    first = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("stop"))

    def step(state: Column, record: Column) -> Column:
        stopped = (state["stop"] > 0) | (record["_step"] > stop_after(state["at"]))
        improves = record["_value"] < state["best"] - F.lit(min_delta)
        moved = F.struct(record["_value"].alias("best"), record["_step"].alias("at"), F.lit(0).cast("bigint").alias("stop"))
        halted = F.struct(state["best"].alias("best"), state["at"].alias("at"), F.lit(1).cast("bigint").alias("stop"))
        return F.when(stopped, halted).when(improves, moved).otherwise(state)

    folded = gathered.withColumn("_f", F.aggregate(live, first, step))
    return _stopped(folded.select(*keys, "n_steps", F.col("_f.at").alias("at"), F.col("_f.best").alias("best")), keys, stop_after)


def _last_in_time(s: Sliced, value: str, stop_after: Callable[[Column], Column]) -> DataFrame:
    """Per series the last record step (``_record``) that came before its series had stopped."""
    seen = s.window().rowsBetween(*ALL_EARLIER)
    rows = s.df.withColumn("_at", F.max("_record").over(seen))
    if s.hot:
        rows = join_carried(s.with_df(rows), {"_at_before": (F.max("_record"), F.max)})
        rows = rows.withColumn("_at", F.coalesce("_at", "_at_before")).drop("_at_before")
    before = F.coalesce("_at", F.lit(0).cast("bigint"))
    too_late = F.col("_record") > stop_after(before)
    best = F.col(value).cast("double")
    stopped = F.min(F.when(too_late, F.struct(before.alias("at"), F.col("_low").cast("double").alias("best"))))
    latest = F.max(F.when(F.col("_record").isNotNull(), F.struct(F.col("_record").alias("at"), best.alias("best"))))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("double").alias("best"))
    return rows.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.coalesce(stopped, latest, none).alias("_f")
    ).select(*s.keys, "n_steps", "_f.at", "_f.best")


def _stopped(found: DataFrame, keys: Sequence[str], stop_after: Callable[[Column], Column]) -> DataFrame:
    """Where a series ends whose last improvement is known."""
    at = F.col("at")
    stop = stop_after(at)
    return found.select(
        *keys,
        "n_steps",
        at.alias("best_step"),
        F.when(at > 0, F.col("best")).alias("best_value"),
        (stop <= F.col("n_steps")).alias("converged"),
        F.least(stop, F.col("n_steps")).alias("last_step"),
    )


def sampler_counts(
    df: DataFrame, key: str = "episode_id", error: str | None = "error", timestamp: str | None = None,
    marks: Sequence[str] = (),
) -> DataFrame:
    """Ticks and errors per log.

    A log with one row per tick counts rows and rows with ``error``. A log with several rows per
    tick names its ``timestamp``, whose distinct values are counted, and the columns in
    ``marks`` that hold ``<error: ..>`` instead of a value, each of which is one error.
    """
    ticks = F.count_distinct(timestamp) if timestamp else F.count(F.lit(1))
    errors = F.count_if(has_error(error)) if error else F.lit(0).cast("bigint")
    for m in marks:
        errors = errors + F.count_if(F.col(m).startswith("<error:"))
    return df.groupBy(key).agg(ticks.alias("sample_count"), errors.alias("error_count"))

