"""Operators of a training-data pipeline: duplicates, leaks, archives, scoring, mixing."""
