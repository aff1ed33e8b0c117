"""Values that results depend on and that therefore must not drift."""

# Class names, positive class last, and the six job families.
LABELS = ("ordinary", "adversarial")
POSITIVE = "adversarial"
FAMILIES = (
    "ordinary_finetune",
    "ordinary_inference",
    "ordinary_training",
    "adversarial_finetune",
    "adversarial_inference",
    "adversarial_training",
)

# GPU metrics of a sample and the statistics made of each.
GPU_METRICS = (
    "gpu_utilization",
    "memory_utilization",
    "memory_used_mb",
    "power_w",
    "temperature_c",
    "sm_clock_mhz",
    "memory_clock_mhz",
    "pcie_tx_mb",
    "pcie_rx_mb",
)
STATS = ("mean", "std", "min", "max", "slope")

# The only metadata fields that may become text. Commands, process names and
# parameters give the label away and are left out on purpose, so this stays a whitelist.
JOB_TEXT_FIELDS = (
    "gpu_name",
    "gpu_index",
    "driver_version",
    "cuda_version",
    "torch_version",
    "python_version",
    "cpu_count",
    "system_ram_gb",
    "gpu_memory_total_gb",
    "duration_seconds",
)

# Columns of the episode index.
INDEX_FIELDS = (
    "episode_id",
    "label",
    "scenario_family",
    "status",
    "duration_seconds",
    "gpu_name",
    "invocation_style",
    "workdir_style",
)
KEY_FIELDS = ("episode_id", "label", "scenario_family")

# Ways in which a planned run is started and where it works.
INVOCATION_STYLES = ("direct", "module", "shell_wrapper")
WORKDIR_STYLES = ("flat", "nested", "tmp")

# Classifiers in the order in which reports list them.
CLASSIFIERS = ("text", "text_svm", "nvml", "combined", "combined_shrunk", "api_baseline")
METRICS = ("accuracy", "precision", "recall", "f1")

# Limits.
TOP_N = 15
IGNORED_LABEL = -100
PATIENCE = 5
MIN_DELTA = 0.01
MIN_STEPS = 5
