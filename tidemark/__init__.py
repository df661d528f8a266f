"""Observability and time-series analytics on Spark."""
