"""Spark-first analytics: transforms, moments, path models, resampling."""
