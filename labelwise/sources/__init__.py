"""Readers and writers (JSON Lines, parquet, registry)."""
