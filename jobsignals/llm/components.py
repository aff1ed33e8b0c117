"""Connected components of a graph given as links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Steps


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """Columns ``id`` and ``root``, the smallest id reachable, for every id that has a link.

    ``links`` has two columns of ids. Each round joins the larger neighbours of every id to the
    smallest one, then the smaller ones, until nothing changes: a number of rounds that grows with
    the logarithm of the longest path. A group's smallest neighbour comes from an aggregate and
    a join, which Spark can split where one id has many links; no list of neighbours is made.
    """
    a, b = links.columns
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    before, turn = None, 0
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = steps.write(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"stars{turn % 2}")
        turn += 1
        steps.remove(f"stars{turn % 2}")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    out = steps.write(roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()), "roots")
    steps.remove("stars0", "stars1")
    return out
