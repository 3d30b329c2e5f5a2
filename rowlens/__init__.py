"""Row-level comparison of tabular datasets on Spark."""

__version__ = "0.1.0"
