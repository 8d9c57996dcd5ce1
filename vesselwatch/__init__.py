"""Vessel-tracking anomaly analytics on Spark, and operators for training data in ``llm``."""
