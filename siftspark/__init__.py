"""Spark-native analytics operators."""
