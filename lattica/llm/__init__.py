"""Operators for training-data pipelines: near-duplicate joins, tokenising, scoring and mixing."""
