"""Values a study fixes before it looks at any result.

Everything is a field of :class:`Study`, so another data set brings its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values (they decide results; kept in their natural order) ----

COHORT_START = "2020-05-06 00:00:00"
COHORT_END = "2020-10-12 23:00:00"
MONTHS = ["20-05", "20-06", "20-07", "20-08", "20-09", "20-10"]
WINDOW_S = 1200
MIN_RUNTIME_S = 1200
FLOOR = 100
N_BOOT = 1000
N_PLACEBOS = 20
SEED = 42
COHORT_SEED_OFFSET = 1000
STRICT_SEED_OFFSET = 2000
MAX_INTERVAL_S = 3600
CUMULATIVE_SHARE = 0.99
QUEUES = ["1", "11"]

EXCLUDED_STATE = "CANCELLED"
BASELINE_STATE = "COMPLETED"
STATES = ["COMPLETED", "FAILED", "OUT_OF_MEMORY", "NODE_FAIL", "TIMEOUT"]
TARGETS = {"target_a": ["FAILED", "OUT_OF_MEMORY", "NODE_FAIL"], "target_b": ["TIMEOUT"]}

PLUGIN_SOURCE = {"ganglia_pub": "ganglia", "ipmi_pub": "IPMI"}
CHANNELS = {
    "mem_total": "ganglia_pub", "mem_free": "ganglia_pub", "mem_cached": "ganglia_pub", "mem_buffers": "ganglia_pub",
    "swap_free": "ganglia_pub", "cpu_wio": "ganglia_pub", "proc_run": "ganglia_pub", "load_one": "ganglia_pub",
    "gpu0_core_temp": "ipmi_pub", "gpu1_core_temp": "ipmi_pub", "gpu3_core_temp": "ipmi_pub", "gpu4_core_temp": "ipmi_pub",
    "gpu0_mem_temp": "ipmi_pub", "gpu4_mem_temp": "ipmi_pub", "fan0_0": "ipmi_pub", "total_power": "ipmi_pub", "ambient": "ipmi_pub",
    "gv100card0": "ipmi_pub", "gv100card3": "ipmi_pub",
}
GROUPS = {
    "mem_active": ["mem_total", "mem_free", "mem_cached", "mem_buffers"],
    "swap_free": ["swap_free"],
    "cpu_wio": ["cpu_wio"],
    "proc_run": ["proc_run"],
    "load_one": ["load_one"],
    "gpu_core_temp": ["gpu0_core_temp", "gpu1_core_temp", "gpu3_core_temp", "gpu4_core_temp"],
    "gpu_mem_temp": ["gpu0_mem_temp", "gpu4_mem_temp"],
    "fan": ["fan0_0"],
    "node_power": ["total_power"],
    "inlet_temp": ["ambient"],
}
COMPOSED = {"mem_active": ("mem_total", ["mem_free", "mem_cached", "mem_buffers"])}
HARDWARE_REGULATED = ["gpu_core_temp", "gpu_mem_temp", "fan", "inlet_temp"]
LOAD_DRIVEN = ["mem_active", "swap_free", "cpu_wio", "proc_run", "load_one", "node_power"]

REQUEST_CATEGORIES = ["qos", "partition"]
REQUEST_NUMBERS = ["time_limit", "mem_req", "num_nodes_req", "num_cores_req", "num_gpus_req", "num_tasks", "cores_per_task"]
FORBIDDEN = ["runtime", "run_time", "end_time", "start_time", "has_ganglia", "user_id", "priority", "nodes_alloc"]

RULES_FIXED = {"R60": 0.60, "R80": 0.80, "R100": 1.00, "R1": 1e-6}
RULES_RELATIVE = {"Rrel": 0.80}
TYPICAL_LEVEL = 0.80


@dataclass(frozen=True)
class Study:
    """All choices of one study; the defaults are the fixed values above."""

    cohort_start: str = COHORT_START
    cohort_end: str = COHORT_END
    months: list[str] = field(default_factory=lambda: list(MONTHS))
    window_s: int = WINDOW_S
    min_runtime_s: int = MIN_RUNTIME_S
    floor: int = FLOOR
    n_boot: int = N_BOOT
    n_placebos: int = N_PLACEBOS
    seed: int = SEED
    max_interval_s: int = MAX_INTERVAL_S
    channels: dict[str, str] = field(default_factory=lambda: dict(CHANNELS))
    plugin_source: dict[str, str] = field(default_factory=lambda: dict(PLUGIN_SOURCE))
    groups: dict[str, list[str]] = field(default_factory=lambda: dict(GROUPS))
    composed: dict[str, tuple[str, list[str]]] = field(default_factory=lambda: dict(COMPOSED))
    queues: list[str] = field(default_factory=lambda: list(QUEUES))

    def source(self, channel: str) -> str:
        return self.plugin_source[self.channels[channel]]

    def groups_of(self, source: str) -> list[str]:
        return [g for g, chans in self.groups.items() if self.source(chans[0]) == source]
