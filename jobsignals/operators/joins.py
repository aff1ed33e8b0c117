"""Joining episode tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import KEY_FIELDS


def fuse_features(
    text: DataFrame, gpu: DataFrame, key: str = "episode_id", shared: Sequence[str] = KEY_FIELDS
) -> DataFrame:
    """Text and GPU features of the episodes that have both; shared columns come from text."""
    repeated = [c for c in shared if c != key and c in gpu.columns]
    return text.join(gpu.drop(*repeated), key, "inner")


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows per key on either side. Keys are counted before they are shuffled."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(key, one.alias("l"), none.alias("r")).unionByName(
        right.select(key, none.alias("l"), one.alias("r"))
    )
    return both.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def reconcile(left: DataFrame, right: DataFrame, key: str = "episode_id") -> DataFrame:
    """One row: rows of both sides, rows of their inner join, keys found on one side only."""
    both = _sides(left, right, key)
    joins = F.col(key).isNotNull()
    zero = F.lit(0).cast("bigint")
    return both.agg(
        F.coalesce(F.sum("l"), zero).alias("left_rows"),
        F.coalesce(F.sum("r"), zero).alias("right_rows"),
        F.coalesce(F.sum(F.when(joins, F.col("l") * F.col("r"))), zero).alias("joined_rows"),
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("left_only"),
        F.count_if((F.col("r") > 0) & (F.col("l") == 0)).alias("right_only"),
    )


def lost_keys(left: DataFrame, right: DataFrame, key: str = "episode_id") -> DataFrame:
    """Keys that an inner join drops, with the side that has them."""
    both = _sides(left, right, key).filter((F.col("l") == 0) | (F.col("r") == 0))
    return both.select(key, F.when(F.col("l") > 0, F.lit("left")).otherwise(F.lit("right")).alias("side"))


def episodes_without_metadata(samples: DataFrame, episodes: DataFrame, key: str = "episode_id") -> DataFrame:
    """Ids that have samples but no metadata."""
    return samples.select(key).distinct().join(episodes.select(key), key, "left_anti")


def attach(df: DataFrame, aggregates: DataFrame, defaults: Mapping[str, object], key: str = "episode_id") -> DataFrame:
    """Add per-episode aggregates; an episode without any gets the defaults."""
    joined = df.join(aggregates.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def scope_connections(
    connections: DataFrame,
    processes: DataFrame,
    tick: Sequence[str] = ("episode_id", "timestamp"),
    pid: str = "pid",
    address: str = "address",
    state: str = "status",
    wanted: str = "ESTABLISHED",
) -> DataFrame:
    """Distinct addresses per tick of the established connections that the episode's own
    processes hold. One row per (tick, address).

    Repeated connections are dropped before the join, on the map side too.
    """
    own = processes.select(*tick, pid).distinct()
    return (
        connections.filter((F.col(state) == wanted) & F.col(address).isNotNull())
        .select(*tick, pid, address)
        .distinct()
        .join(own, [*tick, pid], "left_semi")
        .select(*tick, address)
        .distinct()
    )


def address_lists(scoped: DataFrame, tick: Sequence[str] = ("episode_id", "timestamp"), address: str = "address") -> DataFrame:
    """Sorted ``;``-joined address list per tick, as a network log stores it.

    Takes the distinct rows of :func:`scope_connections`; the list is one field of one row, so
    its length is bounded by the connections one machine holds open at one time.
    """
    joined = F.concat_ws(";", F.array_sort(F.collect_list(address)))
    return scoped.groupBy(*tick).agg(joined.alias("remote_addresses"))
