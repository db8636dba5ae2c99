"""Operators for training-data pipelines: mixing, decontamination, dedup, PII, toxicity and more."""
