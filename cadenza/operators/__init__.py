"""Reusable DataFrame operators, keyed by a session column so that many recordings run in parallel."""
