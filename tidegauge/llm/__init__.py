"""Operators for training-data pipelines: scans, decontamination, similarity, models and tokens."""
