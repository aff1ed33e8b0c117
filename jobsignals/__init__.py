"""Compute-job telemetry analytics as Spark DataFrame, ML and streaming jobs."""

__version__ = "0.1.0"
