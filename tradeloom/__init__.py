"""Spark-native analytics for commerce and logistics records."""
