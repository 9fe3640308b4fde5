"""Spark-native time-series strategy analytics: bars, indicators, as-of merges, order simulation, statistics."""
