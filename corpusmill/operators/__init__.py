"""Operators on DataFrames: extraction, quality, exact and near deduplication, batching, sampling."""
