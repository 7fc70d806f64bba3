"""Spark-native text intelligence and retrieval analytics."""
