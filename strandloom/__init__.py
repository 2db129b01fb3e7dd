"""Spark-native sequence-selection analytics."""
