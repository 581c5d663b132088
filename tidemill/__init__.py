"""Spark-first analytics engine: shipping-priority queries, table profiling and scans over Parquet."""

__version__ = "0.1.0"
