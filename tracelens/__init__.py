"""tracelens: workload-telemetry analytics as DataFrame-in, DataFrame-out operators on PySpark."""

__version__ = "0.1.0"
