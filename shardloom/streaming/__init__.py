"""Telemetry of queries, over tables and over streams."""
