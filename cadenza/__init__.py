"""Timed-signal, speaker and transcript analytics as composable Spark operators."""

__version__ = "0.1.0"
