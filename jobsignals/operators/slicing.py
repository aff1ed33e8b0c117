"""Ordered work on series of any length.

A window over one series runs in one task. That is fine for an ordinary job, but one series
may hold a large share of all samples. The rows of such series are put in order over all
partitions: the window then runs per (series, slice), a slice being a stretch of a series'
rows in one partition, and what a slice needs to know about the ones before it (how many rows, the last
row, the smallest value) comes from a table with one row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# Rows that one task puts in order; longer series are cut. Only speed depends on it.
ROWS_PER_SERIES = 4_000_000
# Partitions into which cut series are dealt, if that leaves none with more rows than the above.
PARTITIONS = 200

SLICE = "_slice"
WHOLE = -1


@dataclass(frozen=True)
class Sliced:
    """Rows, and if any series is cut a ``_slice`` column that never decreases along ``order``
    within a series: the partition, or a stretch of it, for a cut series, ``WHOLE`` for the others."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: bool

    @property
    def group(self) -> tuple[str, ...]:
        return (*self.keys, SLICE) if self.hot else self.keys

    def window(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> Sliced:
        return Sliced(df, self.keys, self.order, self.hot)


def slice_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_series: int = ROWS_PER_SERIES
) -> Sliced:
    """Find the series that are too long for one task and cut them.

    ``order`` has to be total within a series, or rows that are equal in it change places. The rows of all long series,
    however many there are, are range-partitioned together by key and order, into as many partitions as hold
    ``rows_per_series`` rows, and written with the number of their slice: sampled ranges may differ from run to
    run, and rows and carried table must agree on them. A slice is what a series has in a partition. Where that would
    take more than ``PARTITIONS`` (a job of tiny tasks), partitions are larger and sorted, and every
    ``rows_per_series`` rows of one are a slice. Rows of one time are cut apart where the rest of ``order``
    tells them apart. Other series stay as they are. Results do not depend on where a series is cut.

    One job over the key columns counts the rows of each series; without long ones there is no other.
    """
    keys, order = tuple(keys), tuple(order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_series)
    rows = counts.agg(F.sum("_rows")).first()[0]
    if rows is None:
        return Sliced(df, keys, order, False)
    hot = materialise(counts).select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = _all_equal([(df[k], hot[f"_hot_{k}"]) for k in keys])
    wanted = -(-rows // rows_per_series)
    n = max(min(wanted, PARTITIONS), -(-rows // ROWS_PER_SERIES))
    placed = df.join(hot, same, "left_semi").repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    cut = materialise(placed.withColumn(SLICE, _stretch(rows_per_series) if n < wanted else F.spark_partition_id().cast("bigint")))
    return Sliced(cut.unionByName(df.join(hot, same, "left_anti").withColumn(SLICE, F.lit(WHOLE).cast("bigint"))), keys, order, True)


def _stretch(rows: int) -> Column:
    """Number of the stretch of ``rows`` rows that a row is in; it never decreases along partitions and their rows."""
    at = F.monotonically_increasing_id()  # the partition's number in the high bits, the row's in the low 33
    of_row = F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / rows).cast("bigint")
    return F.shiftleft(F.shiftright(at, 33), 33).bitwiseOR(of_row)


def carried(s: Sliced, parts: Mapping[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """One row per (series, slice) with what came before that slice, null in its first one.

    ``parts`` maps a column name to the aggregate made of each slice and the function that
    combines the aggregates of all earlier slices. Only cut series have such rows: one for each of
    their slices.
    """
    per_slice = s.df.filter(F.col(SLICE) != WHOLE).groupBy(*s.group).agg(*[agg.alias(name) for name, (agg, _) in parts.items()])
    earlier = Window.partitionBy(*s.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *s.group, *[combine(F.col(name)).over(earlier).alias(name) for name, (_, combine) in parts.items()]
    )


def join_carried(s: Sliced, parts: Mapping[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """The rows of ``s`` with the carried columns, null in the first slice of a series."""
    table = carried(s, parts)
    renamed = table.select(*[F.col(g).alias(f"_c_{g}") for g in s.group], *parts)
    pairs = [(F.col(g), F.col(f"_c_{g}")) for g in s.group]
    joined = s.df.join(renamed, _all_equal(pairs), "left")
    return joined.drop(*[f"_c_{g}" for g in s.group])


def _all_equal(pairs: Sequence[tuple[Column, Column]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out
