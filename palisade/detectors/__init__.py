"""Anomaly detectors that are fitted and applied as Spark jobs."""
