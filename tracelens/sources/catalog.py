"""The feature catalog: which table and column a feature comes from, and what a feature set needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature -> (table, column).
FEATURES = {
    "cpu_utilization": ("msresource", "cpu_utilization"),
    "memory_utilization": ("msresource", "memory_utilization"),
    "replicas": ("msresource", "replicas"),
    "node_cpu_utilization": ("node", "cpu_utilization"),
    "node_memory_utilization": ("node", "memory_utilization"),
    "providerrpc_rt": ("msrtmcre", "providerrpc_rt"),
    "providerrpc_mcr": ("msrtmcre", "providerrpc_mcr"),
    "consumerrpc_mcr": ("msrtmcre", "consumerrpc_mcr"),
    "http_rt": ("msrtmcre", "http_rt"),
    "http_mcr": ("msrtmcre", "http_mcr"),
    "providermq_rt": ("msrtmcre", "providermq_rt"),
    "providermq_mcr": ("msrtmcre", "providermq_mcr"),
    "consumermq_mcr": ("msrtmcre", "consumermq_mcr"),
    "writemc_mcr": ("msrtmcre", "writemc_mcr"),
    "readmc_mcr": ("msrtmcre", "readmc_mcr"),
    "writedb_mcr": ("msrtmcre", "writedb_mcr"),
    "readdb_mcr": ("msrtmcre", "readdb_mcr"),
}
#: Table -> (key columns, minutes per source file).
TABLES = {"msresource": (("msname", "msinstanceid"), 30), "node": (("nodeid",), 720), "msrtmcre": (("msname", "msinstanceid"), 30)}
#: How a table's features are aggregated in a time bucket.
BUCKET = {"msresource": F.avg, "node": F.avg, "msrtmcre": F.sum}


@dataclass(frozen=True)
class FeatureSet:
    name: str
    features: tuple[str, ...]
    targets: tuple[str, ...]
    base: str = "msresource"
    keys: tuple[str, ...] = ("msname",)

    def __post_init__(self) -> None:
        unknown = [f for f in (*self.features, *self.targets) if f not in FEATURES]
        if unknown:
            raise ValueError(f"{self.name}: unknown features {unknown}")
        if missing := [t for t in self.targets if t not in self.features]:
            raise ValueError(f"{self.name}: targets {missing} aren't among its features")
        if self.base not in TABLES:
            raise ValueError(f"{self.name}: unknown base table {self.base}")

    @property
    def tables(self) -> tuple[str, ...]:
        """The base table first, then the others by name."""
        return (self.base, *sorted({FEATURES[f][0] for f in self.features} - {self.base}))

    def columns(self, table: str) -> list[str]:
        return [FEATURES[f][1] for f in self.features if FEATURES[f][0] == table]

    def aggregates(self, table: str) -> dict[str, Column]:
        return {f: BUCKET[table](FEATURES[f][1]) for f in self.features if FEATURES[f][0] == table}

    @property
    def bounded(self) -> bool:
        """Whether every feature is a share, so that windows may be rounded to two decimals."""
        return all("cpu" in f or "mem" in f for f in self.features)


#: Name, features, targets, base table, join keys.
_SETS = (
    ("cpu", ("cpu_utilization",), ("cpu_utilization",), "msresource", ("msname",)),
    ("cpu_mem", ("cpu_utilization", "memory_utilization"), ("cpu_utilization",), "msresource", ("msname",)),
    ("node_cpu_mem", ("cpu_utilization", "memory_utilization", "node_cpu_utilization", "node_memory_utilization"), ("cpu_utilization",), "msresource", ("nodeid",)),
    ("cpu_mem_mcr", ("cpu_utilization", "memory_utilization", "providerrpc_mcr", "consumerrpc_mcr", "providermq_mcr", "consumermq_mcr", "http_mcr", "writemc_mcr", "readmc_mcr", "writedb_mcr", "readdb_mcr"), ("cpu_utilization",), "msresource", ("msname",)),
    ("threshold_analysis", ("cpu_utilization", "providerrpc_rt", "providerrpc_mcr", "http_rt", "http_mcr", "providermq_rt", "providermq_mcr"), ("cpu_utilization",), "msresource", ("msname", "msinstanceid")),
    ("cpu_mem_both", ("cpu_utilization", "memory_utilization"), ("cpu_utilization", "memory_utilization"), "msresource", ("msname",)),
    ("cpu_mem_http_rpc", ("cpu_utilization", "memory_utilization", "http_mcr", "providerrpc_mcr"), ("cpu_utilization", "memory_utilization"), "msresource", ("msname",)),
    ("mcr_http", ("http_mcr",), ("http_mcr",), "msrtmcre", ("msname",)),
    ("cpu_mem_http_rpc_replicas", ("cpu_utilization", "memory_utilization", "http_mcr", "providerrpc_mcr", "replicas"), ("cpu_utilization", "memory_utilization"), "msresource", ("msname",)),
)
FEATURE_SETS = {name: FeatureSet(name, features, targets, base, keys) for name, features, targets, base, keys in _SETS}


def feature_set(name: str) -> FeatureSet:
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name!r}; known: {sorted(FEATURE_SETS)}")
    return FEATURE_SETS[name]
