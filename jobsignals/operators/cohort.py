"""Choosing, indexing and counting episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import INDEX_FIELDS, KEY_FIELDS, LABELS
from ..functions.ids import pad_id, parse_id_ranges


def split_success(
    episodes: DataFrame, status: str = "status", good: str = "success"
) -> tuple[DataFrame, DataFrame]:
    """Episodes that succeeded, and all others; a missing status is not a success."""
    ok = F.col(status).eqNullSafe(good)
    return episodes.filter(ok), episodes.filter(~ok)


def exclusion_report(excluded: DataFrame, key: str = "episode_id") -> DataFrame:
    """Why each excluded episode was left out."""
    reason = F.coalesce(F.col("error_message"), F.lit("no error message recorded"))
    return excluded.select(key, "status", reason.alias("reason"))


def _merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same numbers as few ranges that neither overlap nor touch, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(r for r in ranges if r[0] <= r[1]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _within(number: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether a number is in one of the ordered ranges: halving, so that any number of them does."""
    if len(ranges) == 1:
        low, high = ranges[0]
        return number == F.lit(low) if low == high else number.between(F.lit(low), F.lit(high))
    half = len(ranges) // 2
    return F.when(number < F.lit(ranges[half][0]), _within(number, ranges[:half])).otherwise(_within(number, ranges[half:]))


def filter_id_ranges(df: DataFrame, column: str, spec: str | None) -> DataFrame:
    """Rows whose id lies in a range spec such as ``060-090,100``; an empty spec keeps all.

    Ids compare in their zero-padded form: ``61`` is not ``061``. A number column compares by
    value, so the limits of the whole spec reach the scan; ranges of any size and number are
    compared by their ends and never listed.
    """
    ranges = parse_id_ranges(spec)
    if ranges is None:
        return df
    ranges = _merged(ranges)
    if not ranges:
        return df.filter(F.lit(False))
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    number = F.col(column).try_cast("bigint") if is_text else F.col(column)
    if is_text:
        df = df.filter(F.col(column).eqNullSafe(pad_id(number)))
    df = df.filter(number.between(F.lit(ranges[0][0]), F.lit(ranges[-1][1])))
    return df if len(ranges) == 1 else df.filter(_within(number, ranges))


def episode_index(episodes: DataFrame, fields: Sequence[str] = INDEX_FIELDS) -> DataFrame:
    """The columns that identify and describe an episode."""
    return episodes.select(*fields)


def feature_columns(df: DataFrame, keys: Sequence[str] = KEY_FIELDS) -> list[str]:
    """All columns that are not keys."""
    return [c for c in df.columns if c not in keys]


def fill_features(df: DataFrame, numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Missing numbers become 0.0, missing text becomes empty."""
    filled = df.fillna(0.0, subset=list(numbers)) if numbers else df
    return filled.fillna("", subset=list(texts)) if texts else filled


def valid_predictions(predictions: DataFrame, labels: Sequence[str] = LABELS, predicted: str = "predicted") -> DataFrame:
    """Predictions that name one of the labels."""
    return predictions.filter(F.col(predicted).isin(list(labels)))


def require_rows(df: DataFrame, k: int) -> DataFrame:
    """``df`` itself, or an error when it has fewer than ``k`` rows. Reads at most ``k``."""
    n = df.limit(k).count()
    if n < k:
        raise ValueError(f"{n} rows, but {k} folds need at least {k}")
    return df


def episode_distribution(index: DataFrame, family: str = "scenario_family", label: str = "label") -> DataFrame:
    """Episodes per family and label, by family."""
    return index.groupBy(family, label).agg(F.count(F.lit(1)).alias("count")).orderBy(family, label)


def status_summary(episodes: DataFrame, status: str = "status") -> DataFrame:
    """Episodes per status."""
    return episodes.groupBy(status).agg(F.count(F.lit(1)).alias("count"))


def usable_summary(episodes: DataFrame, status: str = "status", good: str = "success") -> DataFrame:
    """One row: how many episodes are usable and how many are excluded."""
    ok = F.col(status).eqNullSafe(good)
    return episodes.agg(F.count_if(ok).alias("usable"), F.count_if(~ok).alias("excluded"))


def next_id(episodes: DataFrame, column: str = "episode_id") -> DataFrame:
    """One row: 1 + the largest id that is a number, 1 when there is none."""
    text = F.col(column).cast("string")
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
    return episodes.agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("bigint").alias("next_id"))
