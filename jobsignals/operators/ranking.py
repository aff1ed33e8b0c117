"""Seeded shuffles with exact ranks: folds, balanced assignment, samples.

An exact rank over all rows, or over one of two classes, would be a window in one task. Rows
are ordered by a hash of their id instead, the leading hash digits form buckets that keep that
order, rows are ranked inside (group, bucket), and the number of rows in earlier buckets is
added from a small table of counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FAMILIES, INVOCATION_STYLES, WORKDIR_STYLES
from ..functions.ids import label_of

STYLES = {"invocation_style": INVOCATION_STYLES, "workdir_style": WORKDIR_STYLES}

# 16^4 buckets: the table of counts has at most this many rows per group, and one bucket
# holds about 1/65536 of a group's rows because ids hash evenly.
BUCKET_DIGITS = 4


def shuffle_key(key: str, seed: int) -> Column:
    """Hash that puts ids in a random order; it differs by seed and is the same everywhere."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def _group_key(groups: Sequence[str]) -> Column:
    """One never-null text per group, so that rows without a group keep their place."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups])


def hashed_rank(
    df: DataFrame,
    key: str,
    seed: int,
    groups: Sequence[str] = (),
    name: str = "rank",
    go_on: bool = False,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Rank from 0 of each row inside its group, in hash order. Ids must be unique.

    With ``go_on`` a group's ranks start where the group before it ended; groups should then
    be few, as their counts are added up in one task.
    """
    keyed = df.withColumns({"_order": shuffle_key(key, seed), "_group": _group_key(groups)})
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, digits))
    counts = keyed.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # These windows run over counts, at most 16^digits of them per group.
    span = Window.partitionBy(F.lit(0)) if go_on else Window.partitionBy("_group")
    before = span.orderBy("_group", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_group", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_group", "_bucket").orderBy("_order")
    ranked = keyed.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, ["_group", "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .select(*df.columns, name)
    )


def stratified_folds(
    df: DataFrame, label: str = "label", key: str = "episode_id", k: int = 5, seed: int = 0
) -> DataFrame:
    """Put every row in one of ``k`` folds.

    Rows of a class are dealt out in hash order, and each class goes on where the class before
    it ended. So both the class counts and the sizes of the folds differ by at most one.
    """
    ranked = hashed_rank(df, key, seed, groups=[label], name="_rank", go_on=True)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def balanced_assign(
    df: DataFrame, slots: int, seed: int = 0, key: str = "episode_id", groups: Sequence[str] = ()
) -> DataFrame:
    """Random order of all rows and round-robin slots along it; with ``groups`` each group is
    dealt out on its own, so every slot gets an equal share of every group."""
    ranked = hashed_rank(df, key, seed, groups=groups, name="position")
    return ranked.withColumn("slot", (F.col("position") % slots).cast("int"))


def replicate_counts(
    families: DataFrame, total: int, family: str = "scenario_family", order: Sequence[str] = FAMILIES
) -> DataFrame:
    """Equal shares of ``total`` runs per family; the remainder goes to the first ones in the
    given order, families outside it coming last by name.

    Works on the list of families, a handful of rows.
    """
    n = families.select(family).distinct().count()
    if n == 0 or total < n:
        raise ValueError(f"{total} runs are too few for {n} families")
    place = F.array_position(F.array(*[F.lit(f) for f in order]).cast("array<string>"), F.col(family))
    listed = F.when(place > 0, place).otherwise(len(order) + 1)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(listed, family))
    share = F.lit(total // n) + F.when(rank <= total % n, 1).otherwise(0)
    return families.select(family).distinct().select(family, share.cast("bigint").alias("replicates"))


def assignment_plan(
    families: DataFrame, total: int, slots: int, seed: int = 0, first_id: int = 1, family: str = "scenario_family",
    order: Sequence[str] = FAMILIES,
) -> DataFrame:
    """Plan of ``total`` runs: equal replicates per family in a random order, numbered from
    ``first_id`` and dealt round robin to the slots."""
    shares = {r[0]: r[1] for r in replicate_counts(families, total, family, order).collect()}  # a handful
    names = sorted(shares, key=lambda f: (-shares[f], order.index(f) if f in order else len(order), f))
    small, more = total // len(names), total % len(names)
    # the first ``more`` families have one run more; runs are numbered family by family
    run, edge = F.col("id"), more * (small + 1)
    index = F.when(run < edge, F.floor(run / (small + 1))).otherwise(more + F.floor((run - edge) / small)).cast("int")
    start = F.col("_f") * small + F.least(F.col("_f"), F.lit(more))
    runs = families.sparkSession.range(total).withColumn("_f", index).select(
        F.element_at(F.array(*[F.lit(f) for f in names]), F.col("_f") + 1).alias(family), (run - start).cast("int").alias("replicate")
    )
    keyed = runs.withColumn("_run", F.concat_ws("#", family, F.col("replicate").cast("string")))
    placed = balanced_assign(keyed, slots, seed, "_run")
    number = F.col("position") + first_id
    return placed.select(
        family, "replicate", "position", F.format_string("%03d", number).alias("episode_id"),
        (number - 1).alias("seed"), F.col("slot").alias("gpu_index"),
    )


def styled_plan(
    plan: DataFrame, label: Column | None = None, seed: int = 0, styles: Mapping[str, Sequence[str]] = STYLES,
    key: str = "episode_id", family: str = "scenario_family",
) -> DataFrame:
    """A plan with the label of each run's family and one of several styles per run, drawn apart for each
    column of ``styles``. Draws are hashes of id, seed and column name, so batches with ids of their own
    have draws of their own. A family of no known class is an error unless ``label`` is given."""
    drawn = {}
    for name, values in styles.items():
        digits = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.lit(name))), 1, 8)
        place = F.conv(digits, 16, 10).cast("bigint") % len(values)
        drawn[name] = F.element_at(F.array(*[F.lit(v) for v in values]), place.cast("int") + 1)
    return plan.withColumns({"label": label_of(family) if label is None else label} | drawn)


def sample_where(
    df: DataFrame, condition: Column, n: int, seed: int = 0, key: str = "episode_id"
) -> DataFrame:
    """``n`` random rows among those that meet a condition, all of them if there are fewer.

    No matching row at all is an error. The rows are the first ones in hash order, by exact rank,
    so that no single task has to hold them.
    """
    matching = df.filter(condition)
    if matching.isEmpty():
        raise ValueError("no row meets the condition")
    return hashed_rank(matching, key, seed, name="_rank").filter(F.col("_rank") < n).drop("_rank")
