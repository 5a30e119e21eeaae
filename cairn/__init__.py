"""Spark-native analytics for large point tables."""
