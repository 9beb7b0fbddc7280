"""Spark-native analytics over normalised security events."""
