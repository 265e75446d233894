"""Spark-native processing of classified listings."""
