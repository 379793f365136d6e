"""Endpoint telemetry analytics as Spark jobs: DataFrames in, DataFrames out."""
