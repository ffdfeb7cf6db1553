"""Telemetry analytics on Spark: spans, logs and metrics as DataFrames in, DataFrames out."""
