"""Telemetry as Structured Streaming jobs."""
