"""Raw episodes to the three processed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import GPU_METRICS, JOB_TEXT_FIELDS, STATS
from ..functions.text import kv_text, normalize_text
from ..operators.cohort import episode_index, exclusion_report, filter_id_ranges, split_success, usable_summary
from ..operators.joins import attach, episodes_without_metadata
from ..operators.series import gpu_features
from ..operators.totals import counter_totals, network_summary
from ..session import materialise
from ..sources import raw

NETWORK_DEFAULTS = {"bytes_sent": 0, "bytes_recv": 0, "unique_destinations": 0}
STORAGE_DEFAULTS = {"read_bytes": 0, "write_bytes": 0}


def network_text() -> Column:
    """Network words of a row that carries the network totals."""
    return kv_text(
        {
            "network_bytes_sent": F.col("bytes_sent"),
            "network_bytes_recv": F.col("bytes_recv"),
            "network_unique_destinations": F.col("unique_destinations"),
        }
    )


def storage_text() -> Column:
    """Storage words of a row that carries the counter totals."""
    return kv_text(
        {"storage_read_bytes": F.col("read_bytes"), "storage_write_bytes": F.col("write_bytes")}
    )


def with_network_totals(episodes: DataFrame, network: DataFrame, key: str = "episode_id") -> DataFrame:
    """Network totals per episode, zeros where there is no network log."""
    return attach(episodes, network_summary(network, key), NETWORK_DEFAULTS, key)


def with_storage_totals(
    episodes: DataFrame, processes: DataFrame, key: str = "episode_id", counter_key: str = "pid"
) -> DataFrame:
    """Storage totals per episode, zeros where there is no process log."""
    return attach(episodes, counter_totals(processes, key, counter_key), STORAGE_DEFAULTS, key)


def with_text(
    episodes: DataFrame, network: DataFrame, processes: DataFrame, fields=JOB_TEXT_FIELDS, key: str = "episode_id"
) -> DataFrame:
    """Add ``text_raw`` and ``text_normalized``, made of whitelisted fields and log totals only.

    Logs are reduced to one row per episode before they are joined.
    """
    joined = with_storage_totals(with_network_totals(episodes, network, key), processes, key)
    text = F.concat_ws(" ", kv_text(fields), network_text(), storage_text())
    return (
        joined.withColumn("text_raw", text)
        .withColumn("text_normalized", normalize_text("text_raw"))
        .drop(*NETWORK_DEFAULTS, *STORAGE_DEFAULTS)
    )


def text_features(episodes: DataFrame, network: DataFrame, processes: DataFrame, key: str = "episode_dir") -> DataFrame:
    """Text table: keys, raw text, normalised text."""
    return with_text(episodes, network, processes, key=key).select(
        "episode_id", "label", "scenario_family", "text_raw", "text_normalized"
    )


def gpu_feature_table(episodes: DataFrame, lines: DataFrame, key: str = "episode_dir") -> DataFrame:
    """GPU table: keys and features. All features are null without a log, and zero for a log
    that has only its header, which ``lines`` carries as rows that are no samples."""
    features = gpu_features(lines, key=key, is_sample="is_sample")
    names = [c for c in features.columns if c != key]
    joined = episodes.select(key, "episode_id", "label", "scenario_family").join(features, key, "left")
    return joined.select("episode_id", "label", "scenario_family", *names)


def gpu_feature_names() -> list[str]:
    return ["nvml_sample_count", "nvml_error_rate", *[f"{m}_{s}" for m in GPU_METRICS for s in STATS]]


def build_processed(spark: SparkSession, root: str, id_spec: str | None = None) -> dict[str, DataFrame]:
    """The processed tables, the excluded episodes, the counts of both, the episodes whose
    folder has another name, the folders without metadata and those whose metadata can't be read.

    ``id_spec`` selects folders before their files are opened. Metadata and GPU logs are parsed
    once and kept as tables, since several results start from them; network and process logs
    are read once anyway.
    """

    def chosen(df: DataFrame) -> DataFrame:
        return filter_id_ranges(df, "episode_dir", id_spec)

    unreadable = materialise(chosen(raw.read_unreadable(spark, root)))
    episodes = materialise(chosen(raw.read_episodes(spark, root)))
    ok, excluded = split_success(episodes)
    gpu = materialise(chosen(raw.read_gpu_lines(spark, root)))
    network = chosen(raw.read_network_samples(spark, root))
    processes = chosen(raw.read_process_samples(spark, root))
    known = episodes.select("episode_dir").union(unreadable.select("episode_dir"))
    return {
        "episodes_index": episode_index(ok),
        "text_features": text_features(ok, network, processes),
        "nvml_features": gpu_feature_table(ok, gpu),
        "excluded": exclusion_report(excluded),
        "summary": usable_summary(episodes),
        "renamed": raw.renamed_episodes(episodes),
        "without_metadata": episodes_without_metadata(chosen(raw.episode_folders(spark, root)), known, "episode_dir"),
        "unreadable": unreadable,
    }
