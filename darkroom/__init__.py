"""Spark-native analytics for media and document libraries."""
