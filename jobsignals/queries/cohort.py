"""Selection, indexing, counting, folds, samples, assignment and the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import pad_id
from ..operators import cohort, joins, ranking
from ..session import fresh_path
from ..sources.tables import append_manifest, read_manifest
from .registry import query, table


def episodes(spark, sf):
    """Orders as episodes: F succeeded, O failed, P has no status."""
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("episode_id"),
        F.col("o_orderpriority").alias("scenario_family"),
        F.col("o_orderstatus").alias("label"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") == "O", F.lit("out of memory")).alias("error_message"),
        F.col("o_totalprice").alias("duration_seconds"),
    )


_STATUS = "case o_orderstatus when 'F' then 'success' when 'O' then 'failed' end"


@query("successful_episodes", f"select o_orderkey as episode_id, {_STATUS} as status from orders where o_orderstatus = 'F'")
def successful(spark, sf):
    return cohort.split_success(episodes(spark, sf))[0].select("episode_id", "status")


@query(
    "excluded_episodes",
    f"""select o_orderkey as episode_id, {_STATUS} as status,
               case o_orderstatus when 'O' then 'out of memory' else 'no error message recorded' end as reason
        from orders where o_orderstatus <> 'F'""",
)
def excluded(spark, sf):
    return cohort.exclusion_report(cohort.split_success(episodes(spark, sf))[1])


@query("filter_id_ranges", "select event_id, user_id from events where user_id between 3 and 10 or user_id = 20 or user_id between 50 and 60")
def id_ranges(spark, sf):
    return cohort.filter_id_ranges(table(spark, sf, "events"), "user_id", "005-010,3-7,,20,60-50,50-60").select("event_id", "user_id")


@query(
    "filter_padded_ids",
    "select o_orderkey from orders where o_orderkey between 60 and 90 or o_orderkey between 900 and 1100",
)
def padded_id_ranges(spark, sf):
    o = table(spark, sf, "orders").withColumn("episode_id", pad_id("o_orderkey"))
    return cohort.filter_id_ranges(o, "episode_id", "060-090,900-1100").select("o_orderkey")


@query(
    "episode_index",
    f"select o_orderkey as episode_id, o_orderstatus as label, o_orderpriority as scenario_family, {_STATUS} as status, o_totalprice as duration_seconds from orders",
)
def index(spark, sf):
    return cohort.episode_index(
        episodes(spark, sf), ["episode_id", "label", "scenario_family", "status", "duration_seconds"]
    )


@query("status_summary", f"select {_STATUS} as status, count(*) as count from orders group by 1")
def statuses(spark, sf):
    return cohort.status_summary(episodes(spark, sf))


@query("usable_summary", "select count(*) filter (where o_orderstatus = 'F') as usable, count(*) filter (where o_orderstatus <> 'F') as excluded from orders")
def usable(spark, sf):
    return cohort.usable_summary(episodes(spark, sf))


@query("episode_distribution", "select o_orderpriority as scenario_family, o_orderstatus as label, count(*) as count from orders group by 1, 2")
def distribution(spark, sf):
    return cohort.episode_distribution(episodes(spark, sf))


@query("next_id", "select 1 + max(o_orderkey) as next_id from orders")
def next_free_id(spark, sf):
    ids = episodes(spark, sf).select(pad_id("episode_id").alias("episode_id"))
    return cohort.next_id(ids.unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("episode_id"))))


@query(
    "episodes_without_metadata",
    "select distinct user_id as episode_id from events where user_id not in (select c_custkey from customer where c_acctbal > 0)",
)
def without_metadata(spark, sf):
    samples = table(spark, sf, "events").select(F.col("user_id").alias("episode_id"))
    known = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("episode_id"))
    return joins.episodes_without_metadata(samples, known)


@query(
    "sample_where",
    "select doc_id, text from documents where doc_id in (select doc_id from labels where toxic = 1 order by md5(doc_id || '|7') limit 20)",
)
def sample(spark, sf):
    toxic = ranking.sample_where(table(spark, sf, "labels"), F.col("toxic") == 1, 20, 7, "doc_id")
    return table(spark, sf, "documents").join(toxic, "doc_id", "left_semi").select("doc_id", "text")


@query(
    "sample_where_large",
    "select o_orderkey from orders where o_totalprice > 1000 order by md5(o_orderkey || '|7') limit 12000",
)
def large_sample(spark, sf):
    """More rows than one task should sort, so it goes by exact rank."""
    o = table(spark, sf, "orders")
    return ranking.sample_where(o, F.col("o_totalprice") > 1000, 12_000, 7, "o_orderkey").select("o_orderkey")


@query(
    "stratified_folds",
    "select doc_id, toxic, cast((row_number() over (order by toxic, md5(doc_id || '|0')) - 1) % 5 as integer) as fold from labels",
)
def folds(spark, sf):
    return ranking.stratified_folds(table(spark, sf, "labels"), "toxic", "doc_id").select("doc_id", "toxic", "fold")


@query(
    "balanced_assign",
    """with placed as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by md5(c_custkey || '|3')) - 1 as position from customer)
       select c_custkey, c_mktsegment, position, cast(position % 7 as integer) as slot from placed""",
)
def assigned(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return ranking.balanced_assign(c, 7, 3, "c_custkey", ["c_mktsegment"])


_PLAN = """families as (select distinct o_orderpriority as scenario_family from orders),
sizes as (select scenario_family, row_number() over (order by scenario_family) as r, (select count(*) from families) as k, (select count(*) from customer) as total from families),
runs as (select scenario_family, unnest(range(0, total // k + case when r <= total % k then 1 else 0 end)) as replicate from sizes),
plan as (select *, row_number() over (order by md5(scenario_family || '#' || replicate || '|5')) - 1 as position from runs)"""


@query(
    "assignment_plan",
    f"""with {_PLAN}
        select scenario_family, replicate, position, printf('%03d', position + 100) as episode_id, position + 99 as seed, cast(position % 4 as integer) as gpu_index from plan""",
)
def plan(spark, sf):
    """One run per customer, spread over the order priorities as families."""
    families = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario_family"))
    total = table(spark, sf, "customer").count()
    out = ranking.assignment_plan(families, total, 4, 5, 100)
    return out.withColumn("replicate", F.col("replicate").cast("bigint"))


@query(
    "styled_plan",
    """with runs as (select c_custkey, case when c_nationkey % 2 = 0 then 'ordinary' else 'adversarial' end as label, lower(c_mktsegment) as segment from customer)
       select c_custkey as episode_id, label || '_' || segment as scenario_family, label,
              list_extract(['direct', 'module', 'shell_wrapper'], cast(('0x' || substr(md5(c_custkey || '|6|invocation_style'), 1, 8))::bigint % 3 + 1 as integer)) as invocation_style,
              list_extract(['flat', 'nested', 'tmp'], cast(('0x' || substr(md5(c_custkey || '|6|workdir_style'), 1, 8))::bigint % 3 + 1 as integer)) as workdir_style
       from runs""",
)
def styled(spark, sf):
    """Customers as planned runs of two classes."""
    side = F.when(F.col("c_nationkey") % 2 == 0, "ordinary_").otherwise("adversarial_")
    runs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("episode_id"), F.concat(side, F.lower("c_mktsegment")).alias("scenario_family")
    )
    return ranking.styled_plan(runs, seed=6)


@query(
    "feature_columns",
    """select name, n from (unpivot (select count(columns(* exclude (o_orderkey, o_orderstatus, o_orderpriority))) from orders)
                            on columns(*) into name name value n)""",
)
def filled_features(spark, sf):
    """All columns that are not keys, and how many rows have a value in each."""
    o = table(spark, sf, "orders")
    names = cohort.feature_columns(o, ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return o.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "name", "n")


@query("require_rows", "select c_custkey from customer where c_acctbal > 0")
def required_rows(spark, sf):
    """Customers in credit, who have to be as many as there are folds."""
    return cohort.require_rows(table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey"), 5)


@query(
    "append_manifest",
    """select cast(case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as bigint) as batch, o_orderkey as position, o_orderpriority as scenario_family
       from orders""",
)
def manifest(spark, sf):
    """Three plans appended one after the other."""
    path = fresh_path(spark, "manifest")
    o = table(spark, sf, "orders")
    for status in ("F", "O", "P"):
        batch = o.filter(F.col("o_orderstatus") == status)
        append_manifest(spark, batch.select(F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("scenario_family")), path)
    return read_manifest(spark, path).select("batch", "position", "scenario_family")
