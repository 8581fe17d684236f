"""Spark-native analytics for ordered market data."""
