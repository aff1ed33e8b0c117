"""The list of queries and how the driver tables stand in for episodes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name`` with its check in SQL, if it has one."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals: sums in another order differ in the last bits."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    """Events as samples: user is the episode, type the metric, seconds the time."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("episode_id"),
        F.col("event_type").alias("metric"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        "event_id",
        "value",
        "props",
    )


ORDER = ("timestamp", "event_id")
