"""Spark-native analytics for time-aligned language and motion data."""
