"""Operators for large-scale training-data pipelines (kept apart from the rest of the library)."""
