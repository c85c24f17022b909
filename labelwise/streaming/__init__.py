"""Structured Streaming forms of validation, scoring, metrics and prepare."""
