"""Spark-native text-to-panel analytics."""
