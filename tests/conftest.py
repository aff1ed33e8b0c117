import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobsignals.session import get_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


GPU_HEADER = (
    "timestamp,gpu_index,gpu_uuid,gpu_utilization,memory_utilization,memory_used_mb,power_w,"
    "temperature_c,sm_clock_mhz,memory_clock_mhz,pcie_tx_mb,pcie_rx_mb,error"
)
PROCESS_HEADER = "timestamp,pid,process_name,command_line,cpu_percent,memory_mb,read_bytes,write_bytes"
NETWORK_HEADER = "timestamp,bytes_sent_delta,bytes_recv_delta,remote_addresses,error"


def metadata(episode_id, **over):
    base = {
        "episode_id": episode_id,
        "scenario_family": "ordinary_training",
        "label": "ordinary",
        "status": "success",
        "error_message": "",
        "return_code": 0,
        "start_time": "2026-01-02T03:04:05.250000+00:00",
        "end_time": "2026-01-02T03:04:15.750000+00:00",
        "duration_seconds": 10.5,
        "invocation_style": "direct",
        "workdir_style": "flat",
        "seed": 7,
        "gpu_index": 0,
        "command": ["python", "jobs/adversarial_job.py"],
        "params": {"lr": 3e-05, "is_safe_filter": True},
        "gpu_name": "Some GPU",
        "driver_version": "1.2",
        "cuda_version": "<unavailable: no driver>",
        "python_version": "3.12.3",
        "system_ram_gb": 10000000.0,
    }
    return base | over


@pytest.fixture(scope="session")
def episodes_root(tmp_path_factory):
    """Folders for the cases that raw data shows: see the names of the episodes."""
    root = tmp_path_factory.mktemp("raw")

    def put(folder, meta=None, **files):
        path = root / "episodes" / folder
        path.mkdir(parents=True)
        if meta is not None:
            (path / "metadata.json").write_text(json.dumps(meta, indent=2))
        for name, text in files.items():
            (path / name.replace("__", ".")).write_text(text)

    def gpu(*rows):
        return "\n".join([GPU_HEADER, *rows]) + "\n"

    put(
        "061", metadata("061"),
        nvml__csv=gpu(
            "100.0,0,GPU-a,10,,5.5,1,2,3,4,5,6,",
            "101.0,0,GPU-a,NaN,,5.5,1,2,3,4,5,6,",
            '102.0,0,GPU-a,30,,5.5,1,2,3,4,5,6,"memory_utilization: ""lost"", retry"',
            "103.0,0,GPU-a,70,,5.5,1,2,3,4,5,6,",
        ),
        processes__csv=PROCESS_HEADER + "\n"
        '100.0,1,python,"python a.py\n--flag ""x""",0.0,2.5,100,10\n'
        "101.0,1,python,python a.py,0.0,2.5,250,10\n"
        "101.0,2,<error: NoSuchProcess>,,,,<error: AccessDenied>,\n"
        "102.0,2,bash,bash,0.0,1.0,40,7\n"
        "103.0,2,bash,bash,0.0,1.0,5,7\n"
        "103.0,,bash,bash,0.0,1.0,9999,9999\n",
        network__csv=NETWORK_HEADER + "\n"
        "100.0,0,0,,\n101.0,132,400,1.1.1.1:443;2.2.2.2:80,\n102.0,8,x,2.2.2.2:80,net_io_counters: gone\n",
        shell__log="100.5\tpython a.py\targ\n101.25\tnvidia-smi\n",
    )
    put("062", metadata("062", status="failed", error_message="exit code 1"), nvml__csv=gpu("1,0,g,1,1,1,1,1,1,1,1,1,"))
    put("063", metadata("063", status=None))
    put("064", None, nvml__csv=gpu("1,0,g,1,1,1,1,1,1,1,1,1,"))
    put("065", metadata("0650", label="adversarial", scenario_family="adversarial_finetune"), nvml__csv="", network__csv="", processes__csv="")
    put(
        "066", metadata("066"), nvml__csv=GPU_HEADER + "\n", network__csv=NETWORK_HEADER + "\n",
        processes__csv="timestamp,pid,process_name,command_line,cpu_percent,memory_mb\n1.0,5,bash,bash,0.0,2.0\n",
    )
    put("1000", metadata("1000"), nvml__csv=gpu("5.0,0,g,42,1,1,1,1,1,1,1,1,"))
    return str(root)
