"""Spark-native hybrid search, ranking and retrieval evaluation."""
