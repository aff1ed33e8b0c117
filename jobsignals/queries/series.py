"""Series statistics, totals, gaps and convergence over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import duration_seconds, kbps_to_mbps, to_mib, to_number, to_watts
from ..operators import joins, series, totals
from ..operators.cohort import fill_features
from ..operators.slicing import SLICE, join_carried, slice_series
from ..plans import features
from .registry import ORDER, event_series, query, rounded, table

METRICS = ("click", "purchase", "signup", "value", "view")
FEATURE_COLUMNS = [f"{m}_{s}" for m in METRICS for s in ("mean", "std", "min", "max", "slope")]

_WIDE_SQL = ",\n".join(
    f"""round(coalesce(max(case when metric = '{m}' then {s} end), 0), 6) as {m}_{alias}"""
    for m in METRICS
    for s, alias in (("mean", "mean"), ("std", "std"), ("lo", "min"), ("hi", "max"), ("slope", "slope"))
)


@query(
    "gpu_features",
    f"""
    with long as (
      select user_id, ts, event_id, event_type as metric, value from events where event_type <> 'error'
      union all
      select user_id, ts, event_id, 'value', value from events),
    placed as (
      select *, row_number() over (partition by user_id, metric order by ts, event_id) - 1 as i from long),
    stats as (
      select user_id, metric, avg(value) as mean, stddev_pop(value) as std, min(value) as lo, max(value) as hi,
             case when count(*) > 1 then regr_slope(value, i) else 0 end as slope
      from placed group by user_id, metric),
    quality as (
      select user_id, count(*) as n, avg(case when event_type = 'error' then 1 else 0 end) as e
      from events group by user_id)
    select q.user_id as episode_id, max(q.n) as nvml_sample_count, round(max(q.e), 6) as nvml_error_rate,
      {_WIDE_SQL}
    from quality q left join stats s on q.user_id = s.user_id group by q.user_id
    """,
)
def gpu_features(spark, sf) -> DataFrame:
    e = event_series(spark, sf)
    wide = e.select(
        "episode_id",
        *ORDER,
        *[F.when(F.col("metric") == m, F.col("value")).alias(m) for m in METRICS if m != "value"],
        "value",
        F.when(F.col("metric") == "error", F.col("props")).alias("error"),
    )
    out = series.gpu_features(wide, METRICS, order=ORDER)
    return rounded(out, "nvml_error_rate", *FEATURE_COLUMNS)


@query(
    "sample_quality",
    """select user_id as episode_id, count(*) as sample_count,
              round(avg(case when event_type = 'error' then 1 else 0 end), 6) as error_rate
       from events group by user_id""",
)
def sample_quality(spark, sf):
    e = event_series(spark, sf).withColumn("error", F.when(F.col("metric") == "error", F.col("props")))
    return rounded(series.sample_quality(e), "error_rate")


@query(
    "metric_stats",
    """select user_id as episode_id, event_type as metric, count(value) as n, round(avg(value), 6) as mean,
              round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max
       from events group by user_id, event_type""",
)
def metric_stats(spark, sf):
    return rounded(series.metric_stats(event_series(spark, sf)), "mean", "std")


@query(
    "metric_slope",
    """with placed as (
         select *, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as i from events)
       select user_id as episode_id, event_type as metric,
              round(case when count(*) > 1 then regr_slope(value, i) else 0 end, 6) as slope
       from placed group by user_id, event_type""",
)
def metric_slope(spark, sf):
    return rounded(series.metric_slope(event_series(spark, sf), order=ORDER), "slope")


@query(
    "sample_index",
    """select event_id, user_id as episode_id, event_type as metric,
              row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as sample_index
       from events where value >= 10""",
)
def sample_index(spark, sf):
    e = event_series(spark, sf).withColumn("value", F.when(F.col("value") >= 10, F.col("value")))
    out = series.sample_index(e, order=ORDER)
    return out.select("event_id", "episode_id", "metric", "sample_index")


@query(
    "sample_index_cut_series",
    """select event_id, event_type as metric,
              row_number() over (partition by event_type order by ts, event_id) - 1 as sample_index
       from events""",
)
def sample_index_cut_series(spark, sf):
    """Five series that hold everything: each is cut into time slices."""
    out = series.sample_index(event_series(spark, sf), ["metric"], ORDER, rows_per_series=100)
    return out.select("event_id", "metric", "sample_index")


@query(
    "series_features_cut_series",
    """with placed as (
         select *, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events)
       select event_type as metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std,
              min(value) as min, max(value) as max, round(regr_slope(value, i), 6) as slope
       from placed group by event_type""",
)
def series_features_cut_series(spark, sf):
    out = series.series_features(event_series(spark, sf), ["metric"], ORDER, rows_per_series=100)
    return rounded(out, "mean", "std", "slope")


_RUNNING = """running as (
  select event_id, ts, user_id, event_type,
         sum(cast(round(value * 100) as bigint)) over (
           partition by user_id, event_type order by ts, event_id rows unbounded preceding) as counter
  from events)"""


def running_counter(spark, sf) -> DataFrame:
    """Cumulative counter per (user, type), as a process would report its bytes."""
    rows = event_series(spark, sf).withColumn("_cents", F.round(F.col("value") * 100).cast("bigint"))
    s = slice_series(rows, ["episode_id", "metric"], ORDER)
    so_far = F.sum("_cents").over(s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = s.df.withColumn("counter", so_far)
    if s.hot:
        counted = join_carried(s.with_df(counted), {"_before": (F.sum("_cents"), F.sum)})
        counted = counted.withColumn("counter", F.col("counter") + F.coalesce("_before", F.lit(0))).drop(SLICE, "_before")
    return counted.drop("_cents")


@query(
    "network_totals",
    """select user_id as episode_id, cast(sum(case when event_type = 'error' then 0 else round(value * 100) end) as bigint) as bytes_sent,
              cast(sum(cast(regexp_extract(props, '([0-9]+)', 1) as bigint)) as bigint) as bytes_recv
       from events group by user_id""",
)
def network_totals(spark, sf):
    """Byte counts arrive as text, and as an error mark on some rows."""
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    e = event_series(spark, sf).select(
        "episode_id",
        F.when(F.col("metric") == "error", F.lit("<error: gone>")).otherwise(cents).alias("bytes_sent_delta"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("bytes_recv_delta"),
    )
    return totals.network_totals(e)


_LISTS = """lists as (
  select user_id, event_type || ':' || regexp_extract(props, '([0-9]+)', 1) as a,
         event_type || ':' || cast(cast(floor(value) as bigint) as varchar) as b, event_type from events)"""


def address_rows(spark, sf) -> DataFrame:
    """Two addresses per event in one ``;``-joined list, none for errors."""
    port = F.concat_ws(":", "metric", F.regexp_extract("props", "([0-9]+)", 1))
    other = F.concat_ws(":", "metric", F.floor("value").cast("string"))
    lists = F.when(F.col("metric") != "error", F.concat(port, F.lit(";"), other)).otherwise(F.lit(""))
    return event_series(spark, sf).withColumn("remote_addresses", lists)


@query(
    "distinct_destinations",
    f"""with {_LISTS}, every as (
          select user_id, a as x from lists where event_type <> 'error'
          union all select user_id, b from lists where event_type <> 'error')
        select user_id as episode_id, count(distinct x) as unique_destinations from every group by user_id""",
)
def distinct_destinations(spark, sf):
    return totals.distinct_destinations(address_rows(spark, sf))


@query(
    "counter_totals",
    f"""with {_RUNNING}, top as (
          select user_id, event_type, max(counter) as counter from running group by user_id, event_type)
        select user_id as episode_id, cast(sum(counter) as bigint) as counter from top group by user_id""",
)
def counter_totals(spark, sf):
    return totals.counter_totals(running_counter(spark, sf), counter_key="metric", columns=["counter"])


@query(
    "counter_delta",
    f"""with {_RUNNING}, deltas as (
          select *, counter - lag(counter, 1, 0) over (partition by user_id order by ts, event_id) as d from running)
        select event_id, user_id as episode_id, cast(counter as bigint) as counter, cast(d as bigint) as counter_delta,
               d < 0 as counter_reset
        from deltas""",
)
def counter_delta(spark, sf):
    """Counters of all types of a user as one series, so that it also goes down."""
    out = series.counter_delta(running_counter(spark, sf), ["episode_id"], ORDER, ["counter"], F.lit(0).cast("bigint"))
    return out.select("event_id", "episode_id", "counter", "counter_delta", "counter_reset")


@query(
    "counter_delta_cut_series",
    """select event_id, event_type as metric, cast(event_id - lag(event_id) over (partition by event_type order by ts, event_id) as bigint) as event_id_delta
       from events""",
)
def counter_delta_cut_series(spark, sf):
    out = series.counter_delta(
        event_series(spark, sf), ["metric"], ORDER, ["event_id"], rows_per_series=100
    )
    return out.select("event_id", "metric", "event_id_delta")


@query(
    "sample_gaps",
    """with seconds as (
         select event_id, user_id, epoch_us(ts) / 1000000.0 as t from events),
       steps as (
         select *, t - lag(t) over (partition by user_id order by t, event_id) as d from seconds)
       select event_id, user_id as episode_id, round(d, 3) as elapsed, coalesce(d > 3600, false) as is_late,
              coalesce(d > 36000, false) as is_gap
       from steps""",
)
def sample_gaps(spark, sf):
    out = series.sample_gaps(event_series(spark, sf), ["episode_id"], ORDER, interval=3600.0, factor=10.0)
    return out.select("event_id", "episode_id", F.round("elapsed", 3).alias("elapsed"), "is_late", "is_gap")


@query(
    "sampler_counts",
    """select user_id as episode_id, count(distinct date_trunc('day', ts)) as sample_count,
              count(*) filter (where event_type = 'error') as error_count
       from events group by user_id""",
)
def sampler_counts(spark, sf):
    """A tick is a day with several rows; an error mark sits in place of the name."""
    e = event_series(spark, sf).select(
        "episode_id",
        F.floor(F.col("timestamp") / 86400).alias("tick"),
        F.when(F.col("metric") == "error", F.lit("<error: gone>")).otherwise(F.col("metric")).alias("process_name"),
    )
    return series.sampler_counts(e, error=None, timestamp="tick", marks=["process_name"])


# A step improves when it is more than 1 below the best so far. Both are found by recursion.
_CONVERGENCE = """
with recursive steps as (
  select user_id, value, row_number() over (partition by user_id order by ts, event_id) as step,
         count(*) over (partition by user_id) as n from events),
walk as (
  select user_id, step, n, value as best, 1 as best_step, 0 as since, false as done from steps where step = 1
  union all
  select s.user_id, s.step, s.n,
         case when s.value < w.best - 1 then s.value else w.best end,
         case when s.value < w.best - 1 then s.step else w.best_step end,
         case when s.value < w.best - 1 then 0 else w.since + 1 end,
         s.step >= 5 and not (s.value < w.best - 1) and w.since + 1 >= 5
  from walk w join steps s on s.user_id = w.user_id and s.step = w.step + 1
  where not w.done)
select user_id as episode_id, max(n) as n_steps, arg_max(best_step, step) as best_step, arg_max(best, step) as best_value,
       bool_or(done) as converged, max(step) as last_step
from walk group by user_id
"""


@query("convergence", _CONVERGENCE)
def convergence(spark, sf):
    return series.convergence(event_series(spark, sf), ["episode_id"], ORDER, "value", min_delta=1.0)


@query("convergence_any_fall", _CONVERGENCE.replace("w.best - 1", "w.best"))
def convergence_any_fall(spark, sf):
    """Every fall below the best so far counts."""
    return series.convergence(event_series(spark, sf), ["episode_id"], ORDER, "value", min_delta=0.0)


@query(
    "unit_conversion",
    """select l_orderkey, l_linenumber, l_partkey, round_even(floor(l_extendedprice) / 1000.0, 3) as watts,
              round_even(l_extendedprice * 1000 / 1048576.0, 3) as mib, round_even(l_quantity / 1024.0, 3) as mbps
       from lineitem""",
)
def unit_conversion(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        to_watts(F.floor("l_extendedprice")).alias("watts"),
        to_mib(F.col("l_extendedprice") * 1000).alias("mib"),
        kbps_to_mbps("l_quantity").alias("mbps"),
    )


@query(
    "number_parsing",
    """select event_id, try_cast(case when event_type = 'error' then '<error: x>' when event_type = 'view' then 'NaN'
                else regexp_extract(props, '([0-9]+)', 1) end as double) as number
       from events where event_type <> 'view'
       union all select event_id, null from events where event_type = 'view'""",
)
def number_parsing(spark, sf):
    text = (
        F.when(F.col("metric") == "error", "<error: x>")
        .when(F.col("metric") == "view", "NaN")
        .otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    )
    return event_series(spark, sf).select("event_id", to_number(text).alias("number"))


@query(
    "episode_duration",
    """select user_id as episode_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) as duration_seconds
       from events group by user_id""",
)
def episode_duration(spark, sf):
    spans = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode_id")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    return spans.select("episode_id", duration_seconds("start", "end").alias("duration_seconds"))


@query(
    "scope_connections",
    """with own as (select distinct user_id, date_trunc('day', ts) as day, event_type from events where event_type <> 'error'),
       conns as (
         select user_id, date_trunc('day', ts) as day, event_type, 'n' || c_nationkey || ':' || (event_id % 7) as address,
                case when value >= 5 then 'ESTABLISHED' else 'LISTEN' end as status
         from events join customer on user_id = c_custkey),
       kept as (
         select distinct user_id, day, address from conns
         where status = 'ESTABLISHED' and (user_id, day, event_type) in (select user_id, day, event_type from own))
       select user_id as episode_id, cast(epoch(day) / 86400 as bigint) as timestamp, string_agg(address, ';' order by address) as remote_addresses
       from kept group by user_id, day""",
)
def scope_connections(spark, sf):
    day = F.floor(F.col("timestamp") / 86400)
    e = event_series(spark, sf).withColumn("timestamp", day)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("episode_id"), "c_nationkey")
    connections = e.join(c, "episode_id").select(
        "episode_id", "timestamp", F.col("metric").alias("pid"),
        F.concat(F.lit("n"), F.col("c_nationkey"), F.lit(":"), F.col("event_id") % 7).alias("address"),
        F.when(F.col("value") >= 5, "ESTABLISHED").otherwise("LISTEN").alias("status"),
    )
    processes = e.filter(F.col("metric") != "error").select("episode_id", "timestamp", F.col("metric").alias("pid"))
    return joins.address_lists(joins.scope_connections(connections, processes))


_NET = f"""{_LISTS}, every as (
  select user_id, a as x from lists where event_type <> 'error'
  union all select user_id, b from lists where event_type <> 'error'),
net as (
  select user_id, cast(sum(round(value * 100)) as bigint) as s, cast(sum(cast(regexp_extract(props, '([0-9]+)', 1) as bigint)) as bigint) as r
  from events group by user_id),
dest as (select user_id, count(distinct x) as d from every group by user_id)"""
_NET_TEXT = """'network_bytes_sent=' || coalesce(s, 0) || ' network_bytes_recv=' || coalesce(r, 0) || ' network_unique_destinations=' || coalesce(d, 0)"""
_STORE_TEXT = """'storage_read_bytes=' || coalesce(counter, 0) || ' storage_write_bytes=' || coalesce(counter, 0)"""


def network_rows(spark, sf) -> DataFrame:
    return address_rows(spark, sf).select(
        "episode_id", "remote_addresses",
        F.round(F.col("value") * 100).alias("bytes_sent_delta"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("bytes_recv_delta"),
    )


def process_rows(spark, sf) -> DataFrame:
    c = running_counter(spark, sf)
    return c.select("episode_id", F.col("metric").alias("pid"), F.col("counter").alias("read_bytes"), F.col("counter").alias("write_bytes"))


def customers(spark, sf) -> DataFrame:
    """Customers as episodes; most of them have no events."""
    return table(spark, sf, "customer").withColumn("episode_id", F.col("c_custkey"))


@query(
    "network_text",
    f"""with {_NET} select c_custkey as episode_id, {_NET_TEXT} as text
        from customer left join net on c_custkey = net.user_id left join dest on c_custkey = dest.user_id""",
)
def network_text(spark, sf):
    rows = features.with_network_totals(customers(spark, sf), network_rows(spark, sf))
    return rows.select("episode_id", features.network_text().alias("text"))


@query(
    "storage_text",
    f"""with {_RUNNING}, top as (select user_id, event_type, max(counter) as counter from running group by user_id, event_type),
        store as (select user_id, cast(sum(counter) as bigint) as counter from top group by user_id)
        select c_custkey as episode_id, {_STORE_TEXT} as text from customer left join store on c_custkey = user_id""",
)
def storage_text(spark, sf):
    rows = features.with_storage_totals(customers(spark, sf), process_rows(spark, sf))
    return rows.select("episode_id", features.storage_text().alias("text"))


@query(
    "text_features",
    f"""with {_RUNNING}, {_NET}, top as (select user_id, event_type, max(counter) as counter from running group by user_id, event_type),
        store as (select user_id, cast(sum(counter) as bigint) as counter from top group by user_id),
        raw as (
          select c_custkey, 'c_name=' || c_name || ' c_mktsegment=' || c_mktsegment || ' c_nationkey=' || c_nationkey || ' run=run_' || lpad(cast(c_custkey as varchar), 5, '0')
                 || ' ' || {_NET_TEXT} || ' ' || {_STORE_TEXT} as text_raw
          from customer left join net on c_custkey = net.user_id left join dest on c_custkey = dest.user_id
               left join store on c_custkey = store.user_id)
        select c_custkey as episode_id, text_raw, regexp_replace(text_raw, 'run_[0-9]+', '<ID>') as text_normalized from raw""",
)
def text_features(spark, sf):
    fields = ["c_name", "c_mktsegment", "c_nationkey", "run"]
    episodes = customers(spark, sf).withColumn("run", F.format_string("run_%05d", "c_custkey"))
    out = features.with_text(episodes, network_rows(spark, sf), process_rows(spark, sf), fields)
    return out.select("episode_id", "text_raw", "text_normalized")


@query(
    "attach_defaults",
    """select c_custkey as episode_id, coalesce(n, 0) as orders, round(coalesce(total, 0.0), 2) as total
       from customer left join (
         select o_custkey, count(*) as n, sum(o_totalprice) as total from orders group by o_custkey) on c_custkey = o_custkey""",
)
def attach_defaults(spark, sf):
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("episode_id")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total")
    )
    out = joins.attach(customers(spark, sf), per, {"orders": 0, "total": 0.0})
    return out.select("episode_id", "orders", F.round("total", 2).alias("total"))


@query(
    "fill_missing",
    """select event_id, coalesce(case when event_type <> 'error' then value end, 0.0) as value,
              coalesce(case when event_type <> 'view' then props end, '') as props from events""",
)
def fill_missing(spark, sf):
    e = event_series(spark, sf).select(
        "event_id",
        F.when(F.col("metric") != "error", F.col("value")).alias("value"),
        F.when(F.col("metric") != "view", F.col("props")).alias("props"),
    )
    return fill_features(e, ["value"], ["props"])
