"""Operators for training-data pipelines: dedup, language, archives, mixing, scoring, filters."""
