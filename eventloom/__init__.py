"""Spark-native graph and event analytics."""
