"""Whole runs: stages put together, counters and reports."""
