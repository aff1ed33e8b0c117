from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jobsignals.constants import CLASSIFIERS
from jobsignals.operators.joins import episodes_without_metadata
from jobsignals.operators.metrics import binary_metrics, family_accuracy
from jobsignals.operators.series import sampler_counts
from jobsignals.plans.comparison import comparison_report, write_comparison
from jobsignals.plans.features import build_processed, gpu_feature_names
from jobsignals.sources import raw, tables


@pytest.fixture(scope="module")
def built(spark, episodes_root):
    return build_processed(spark, episodes_root)


def by_id(df):
    return {r["episode_id"]: r.asDict() for r in df.collect()}


def test_metadata_keeps_digits_and_types(spark, episodes_root):
    row = raw.read_episodes(spark, episodes_root).filter("episode_dir = '061'").first()
    assert (row.episode_id, row.duration_seconds, row.duration, row.system_ram_gb) == ("061", "10.5", 10.5, "10000000.0")
    assert row.params["is_safe_filter"] == "true" and row.ended > row.started and row.cpu_count is None


def test_excluded_episodes_are_reported(built):
    excluded = by_id(built["excluded"])
    assert excluded["062"]["reason"] == "exit code 1" and excluded["063"]["status"] is None
    assert built["summary"].first().asDict() == {"usable": 4, "excluded": 2}
    assert sorted(by_id(built["episodes_index"])) == ["061", "0650", "066", "1000"]


def test_folder_and_metadata_ids_may_differ(built):
    assert [tuple(r) for r in built["renamed"].collect()] == [("065", "0650")]


def test_samples_without_metadata(spark, episodes_root, built):
    assert [r[0] for r in built["without_metadata"].collect()] == ["064"]
    gpu, episodes = raw.read_gpu_samples(spark, episodes_root), raw.read_episodes(spark, episodes_root)
    assert [r[0] for r in episodes_without_metadata(gpu, episodes, "episode_dir").collect()] == ["064"]


def test_folders_without_or_with_broken_metadata(spark, tmp_path):
    for folder, file, text in (("001", "metadata.json", '{"episode_id": "001", "status": "success"}'), ("002", "network.csv", "x"),
                               ("003", "shell.log", "y"), ("004", "nvml.csv", "\n"), ("005", "metadata.json", "no json")):
        (tmp_path / "episodes" / folder).mkdir(parents=True)
        (tmp_path / "episodes" / folder / file).write_text(text)
    built = build_processed(spark, str(tmp_path))
    assert sorted(r[0] for r in built["without_metadata"].collect()) == ["002", "003", "004"]
    assert [r.episode_dir for r in built["unreadable"].collect()] == ["005"]
    assert [r.episode_id for r in built["episodes_index"].collect()] == ["001"] and built["excluded"].count() == 0
    assert build_processed(spark, str(tmp_path), "001-002")["without_metadata"].collect()[0][0] == "002"


def test_text_features(built):
    text = by_id(built["text_features"])
    assert text["061"]["text_raw"] == (
        "gpu_name=Some GPU gpu_index=0 driver_version=1.2 cuda_version=<unavailable: no driver> torch_version=None "
        "python_version=3.12.3 cpu_count=None system_ram_gb=10000000.0 gpu_memory_total_gb=None duration_seconds=10.5 "
        "network_bytes_sent=140 network_bytes_recv=400 network_unique_destinations=2 "
        "storage_read_bytes=290 storage_write_bytes=17"
    )
    for episode in ("0650", "066", "1000"):
        assert text[episode]["text_raw"].endswith(
            "network_bytes_sent=0 network_bytes_recv=0 network_unique_destinations=0 "
            "storage_read_bytes=0 storage_write_bytes=0"
        )


def test_nothing_that_names_the_label_reaches_the_features(built):
    for name in ("text_features", "nvml_features"):
        for row in built[name].drop("label", "scenario_family").collect():
            joined = " ".join(str(v) for v in row)
            assert "adversarial" not in joined and "is_safe" not in joined and "jobs/" not in joined


def test_gpu_features(built):
    rows = by_id(built["nvml_features"])
    assert built["nvml_features"].columns[3:] == gpu_feature_names()
    a = rows["061"]
    assert (a["nvml_sample_count"], a["nvml_error_rate"]) == (4, 0.25)
    assert a["gpu_utilization_mean"] == pytest.approx(110 / 3) and a["gpu_utilization_slope"] == pytest.approx(30.0)
    assert a["gpu_utilization_std"] == pytest.approx((sum((x - 110 / 3) ** 2 for x in (10, 30, 70)) / 3) ** 0.5)
    assert {a[f"memory_utilization_{s}"] for s in ("mean", "std", "min", "max", "slope")} == {0.0}
    assert (a["memory_used_mb_std"], a["memory_used_mb_slope"]) == (0.0, 0.0)
    one = rows["1000"]
    assert (one["gpu_utilization_mean"], one["gpu_utilization_std"], one["gpu_utilization_slope"]) == (42.0, 0.0, 0.0)


def test_missing_log_is_null_and_header_only_is_zero(built):
    rows = by_id(built["nvml_features"])
    assert all(rows["0650"][c] is None for c in gpu_feature_names())
    assert all(rows["066"][c] == 0 for c in gpu_feature_names())


def test_id_ranges_choose_folders(spark, episodes_root):
    index = build_processed(spark, episodes_root, "061-062,1000")["episodes_index"]
    assert sorted(by_id(index)) == ["061", "1000"]


def test_process_rows_with_quotes_line_breaks_and_old_layout(spark, episodes_root):
    rows = raw.read_process_samples(spark, episodes_root)
    first = rows.filter("episode_dir = '061' and timestamp = 100").first()
    assert first.command_line == 'python a.py\n--flag "x"' and first.read_bytes == "100"
    assert rows.filter("episode_dir = '066'").first().read_bytes is None
    counts = sampler_counts(rows, "episode_dir", None, "timestamp", ["process_name", "read_bytes"])
    assert {r[0]: (r[1], r[2]) for r in counts.collect()} == {"061": (4, 2), "066": (1, 0)}


def test_unknown_layout_stops(spark, tmp_path):
    path = tmp_path / "episodes" / "001"
    path.mkdir(parents=True)
    (path / "network.csv").write_text("timestamp,bytes_recv_delta,bytes_sent_delta,remote_addresses,error\n1,2,3,,\n")
    with pytest.raises(PySparkException, match="unknown network log layout"):
        raw.read_network_samples(spark, str(tmp_path)).collect()


def test_no_log_at_all_is_empty(spark, tmp_path):
    (tmp_path / "episodes" / "001").mkdir(parents=True)
    assert raw.read_gpu_samples(spark, str(tmp_path)).count() == 0
    assert raw.read_shell_log(spark, str(tmp_path)).count() == 0


def test_shell_log_splits_at_the_first_tab(spark, episodes_root):
    rows = raw.read_shell_log(spark, episodes_root).orderBy("timestamp").collect()
    assert [tuple(r) for r in rows] == [("061", 100.5, "python a.py\targ"), ("061", 101.25, "nvidia-smi")]


def test_processed_tables_are_replaced_and_loaded_filled(spark, built, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        tables.write_processed({n: built[n] for n in ("text_features", "nvml_features")}, out)
    assert tables.read_processed(spark, out, "text_features").count() == 4
    loaded = tables.load_features(spark, out, "nvml_features")
    assert loaded.filter(" or ".join(f"{c} is null" for c in gpu_feature_names())).count() == 0
    tables.write_processed({"episodes_index": built["episodes_index"]}, out, "csv")
    assert spark.read.option("header", True).csv(tables.processed_paths(spark, out)["episodes_index"]).filter("episode_id = '061'").count() == 1


def test_processed_tables_change_together_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "processed")

    def values(name):
        return sorted(r.v for r in tables.read_processed(spark, out, name).collect())

    def rows(v):
        return spark.range(3).select(F.lit(v).alias("v"))

    tables.write_processed({"a": rows(1), "b": rows(1), "c": rows(1)}, out)
    held = tables.read_processed(spark, out, "a")
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        tables.write_processed({"a": rows(2), "b": broken, "c": rows(2)}, out)
    assert values("a") == values("b") == values("c") == [1, 1, 1]
    tables.write_processed({"a": rows(3), "b": rows(3)}, out)
    assert (values("a"), values("b"), values("c")) == ([3] * 3, [3] * 3, [1] * 3) and held.count() == 3
    for v in range(4, 8):
        tables.write_processed({"a": rows(v)}, out)
    assert (values("a"), values("b"), values("c")) == ([7] * 3, [3] * 3, [1] * 3)
    assert len(list((tmp_path / "processed" / "_versions" / "data").iterdir())) <= 5
    with pytest.raises(FileNotFoundError):
        tables.read_processed(spark, out, "d")


def test_results_keep_other_classifiers_and_report_missing(spark, tmp_path):
    out = str(tmp_path / "results")
    assert comparison_report(spark, out) == ({}, list(CLASSIFIERS))
    assert write_comparison(spark, out) == ([], list(CLASSIFIERS))
    for name, right in (("text", 1), ("nvml", 2), ("text", 3)):
        pred = spark.createDataFrame(
            [(str(i), "f", "ordinary", "ordinary" if i < right else "adversarial", i < right) for i in range(4)],
            "episode_id string, scenario_family string, label string, predicted string, correct boolean",
        )
        tables.write_results(name, out, predictions=pred, metrics=binary_metrics(pred), families=family_accuracy(pred))
    report, missing = comparison_report(spark, out)
    assert missing == ["text_svm", "combined", "combined_shrunk", "api_baseline"]
    assert report["per_family_accuracy"].first().asDict() == {"family": "f", "text": 0.75, "nvml": 0.5}
    assert report["score_bars"].count() == 8
    for _ in range(2):
        assert write_comparison(spark, out) == (["text", "nvml"], missing)
    paths = tables.processed_paths(spark, f"{out}/comparison_report")
    assert set(paths) == set(report)
    for name, df in report.items():
        again = spark.read.schema(df.schema).json(paths[name])
        assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        tables.write_results("text", out, wrong=report["overall"])


def test_manifest_grows_by_batches(spark, tmp_path):
    path = str(tmp_path / "manifest")
    for batch in range(3):
        plan = spark.range(batch + 1).select(F.col("id").alias("position"))
        assert tables.append_manifest(spark, plan, path) == batch
    rows = tables.read_manifest(spark, path).orderBy("batch", "position").collect()
    assert [(r.batch, r.position) for r in rows] == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_writers_of_a_manifest_at_once_take_different_batches(spark, tmp_path):
    path = str(tmp_path / "manifest")
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: tables.append_manifest(spark, spark.range(k + 1).select(F.col("id").alias("position"), F.lit(k).alias("by")), path), range(6)))
    assert sorted(got) == list(range(6))
    sizes = {r.by: (r.batch, r.n) for r in tables.read_manifest(spark, path).groupBy("by", "batch").agg(F.count("*").alias("n")).collect()}
    assert sizes == {k: (batch, k + 1) for k, batch in enumerate(got)}


def test_a_manifest_without_taken_numbers_goes_on(spark, tmp_path):
    path = str(tmp_path / "manifest")
    spark.range(1).select(F.col("id").alias("position")).write.parquet(path + "/batch=4")
    assert tables.append_manifest(spark, spark.range(2).select(F.col("id").alias("position")), path) == 5
    assert tables.read_manifest(spark, path).count() == 3
