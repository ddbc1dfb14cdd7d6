"""Spark-native analytics for labelled flow and event tables."""
