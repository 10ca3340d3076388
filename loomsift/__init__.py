"""Compaction, redaction, profiling and metering of captured text on Spark."""

__version__ = "0.1.0"
