"""Processed tables, result tables and the manifest."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASSIFIERS
from ..operators.cohort import feature_columns, fill_features
from . import numbered

RESULT_TABLES = ("predictions", "metrics", "confusion", "families", "terms", "runs")


VERSIONS = "_versions"


def write_processed(tables: Mapping[str, DataFrame], out: str, fmt: str = "parquet") -> None:
    """Replace these tables of ``out`` as one; other tables there stay as they are.

    The tables are written to a folder of their own, and readers see them when all are complete: the
    last step is a small file that names them. A write that fails half way changes nothing for readers. Of
    several writers the one that began last counts. What was replaced goes with the next write but one, so
    that jobs that read it can end.
    """
    if not tables:
        return
    spark, out = next(iter(tables.values())).sparkSession, out.rstrip("/")
    number = numbered.next_number(spark, f"{out}/{VERSIONS}")
    for name, df in tables.items():
        writer = df.write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        if fmt == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.save(f"{out}/{VERSIONS}/data/{number}/{name}")
    before = _versions(spark, out)
    numbered.put(spark, f"{out}/{VERSIONS}/{number}.json", json.dumps({"tables": list(tables), "format": fmt}))
    needed = set(_latest(before).values())
    for old in before:
        if old not in needed and old < number:
            numbered.remove(spark, f"{out}/{VERSIONS}/{old}.json")
            numbered.remove(spark, f"{out}/{VERSIONS}/data/{old}")


def _versions(spark: SparkSession, out: str) -> dict[int, dict]:
    """All complete writes by number, the earliest first."""
    found = sorted(int(n.removesuffix(".json")) for n in numbered.names(spark, f"{out}/{VERSIONS}") if n.endswith(".json") and n[0] != ".")
    return {n: json.loads(numbered.get(spark, f"{out}/{VERSIONS}/{n}.json")) for n in found}


def _latest(versions: Mapping[int, dict]) -> dict[str, int]:
    return {name: n for n, v in versions.items() for name in v["tables"]}


def processed_paths(spark: SparkSession, out: str) -> dict[str, str]:
    """Where each table is now; tables that are read from one answer belong together."""
    out = out.rstrip("/")
    return {name: f"{out}/{VERSIONS}/data/{n}/{name}" for name, n in _latest(_versions(spark, out)).items()}


def read_processed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table that was written as Parquet."""
    paths = processed_paths(spark, out)
    if name not in paths:
        raise FileNotFoundError(f"no table {name} in {out}")
    return spark.read.parquet(paths[name])


def load_features(spark: SparkSession, out: str, name: str, texts: Sequence[str] = ()) -> DataFrame:
    """A processed table ready for training: missing text empty, missing numbers 0.0."""
    df = read_processed(spark, out, name)
    numbers = [] if texts else feature_columns(df)
    return fill_features(df, numbers, texts)


def write_results(name: str, out: str, **tables: DataFrame) -> None:
    """Write the result tables of one classifier; those of others stay as they are."""
    for table, df in tables.items():
        if table not in RESULT_TABLES:
            raise ValueError(f"no result table is called {table}")
        (
            df.withColumn("classifier", F.lit(name))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("classifier")
            .parquet(f"{out.rstrip('/')}/{table}")
        )


def load_results(
    spark: SparkSession, out: str, expected: Sequence[str] = CLASSIFIERS
) -> tuple[dict[str, DataFrame], list[str]]:
    """The result tables found, and the expected classifiers without any result."""
    found: dict[str, DataFrame] = {}
    for table in RESULT_TABLES:
        try:
            found[table] = spark.read.parquet(f"{out.rstrip('/')}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if "metrics" not in found:
        return found, list(expected)
    present = {r[0] for r in found["metrics"].select("classifier").distinct().collect()}
    return found, [c for c in expected if c not in present]


def append_manifest(spark: SparkSession, plan: DataFrame, path: str) -> int:
    """Add a plan to the manifest as its next batch and return the batch number.

    Earlier batches are never rewritten. ``plan`` has a ``position`` column. Several writers may append at
    once: a number is taken before its batch is written, and none is given twice. A write that fails leaves its
    number unused.
    """
    path = path.rstrip("/")
    written = [int(n.removeprefix("batch=")) for n in numbered.names(spark, path) if n.startswith("batch=")]
    batch = numbered.next_number(spark, f"{path}/_taken", max(written, default=-1) + 1)
    plan.write.parquet(f"{path}/batch={batch}")
    return batch


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All batches; ``orderBy('batch', 'position')`` gives the order in which they were planned."""
    return spark.read.option("mergeSchema", True).parquet(path).withColumn("batch", F.col("batch").cast("bigint"))
