"""Lenient parsing, units, durations and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Parse as double; text that is no number, and NaN itself, become null."""
    number = _col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_count(c: Column | str) -> Column:
    """A sum as a whole number, truncated, with null read as zero."""
    return F.coalesce(_col(c), F.lit(0.0)).cast("bigint")


def to_watts(milliwatts: Column | str) -> Column:
    return F.bround(_col(milliwatts) / 1000.0, 3)


def to_mib(n_bytes: Column | str) -> Column:
    return F.bround(_col(n_bytes) / float(1024**2), 3)


def kbps_to_mbps(kbps: Column | str) -> Column:
    return F.bround(_col(kbps) / 1024.0, 3)


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds between two timestamps, to the millisecond."""
    micros = F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))
    return F.round(micros / F.lit(1e6), 3)


def ratio(part: Column, whole: Column, undefined: float | None = 0.0) -> Column:
    """``part / whole``, or ``undefined`` where the denominator is zero or null."""
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if undefined is None else F.coalesce(value, F.lit(undefined))
