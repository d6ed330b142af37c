"""Telemetry lakehouse operators on Spark DataFrames."""
