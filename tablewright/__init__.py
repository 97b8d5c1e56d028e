"""Spark-native dataset catalogue, column profiler and text-corpus quality engine."""
