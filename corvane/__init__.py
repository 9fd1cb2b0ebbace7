"""Spark-native embedding alignment and retrieval analytics."""
