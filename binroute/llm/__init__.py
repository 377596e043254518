"""Operators for training-data pipelines over text; optional and self-contained."""
