"""Spark-native retrieval, evaluation and corpus engine."""
