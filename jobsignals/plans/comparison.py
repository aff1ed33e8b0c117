"""Result tables to the comparison report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..constants import CLASSIFIERS, METRICS
from ..operators.metrics import chart_data, compare
from ..sources.tables import load_results, write_processed


def comparison_report(
    spark: SparkSession, results: str, expected: Sequence[str] = CLASSIFIERS
) -> tuple[dict[str, DataFrame], list[str]]:
    """Scores by classifier, accuracy by family and classifier, chart rows of both, and the
    classifiers that have no result. Nothing but the missing names when there are no results."""
    found, missing = load_results(spark, results, expected)
    if "metrics" not in found:
        return {}, missing
    present = [c for c in expected if c not in missing]
    overall = found["metrics"].select("classifier", *METRICS)
    families = compare(found["families"], present)
    bars, groups = chart_data(overall, families)
    return {"overall": overall, "per_family_accuracy": families, "score_bars": bars, "family_bars": groups}, missing


def write_comparison(
    spark: SparkSession, results: str, expected: Sequence[str] = CLASSIFIERS
) -> tuple[list[str], list[str]]:
    """Write the report as JSON tables beside the results, in ``comparison_report``, replacing the last one as a whole.

    Returns the classifiers compared and those without a result. Without any result nothing is written.
    ``sources.tables.processed_paths`` says where each table is; missing accuracies are written as null.
    """
    report, missing = comparison_report(spark, results, expected)
    if report:
        write_processed(report, f"{results.rstrip('/')}/comparison_report", "json")
    return [c for c in expected if c not in missing], missing
