"""Spark-native analytics for text-anchored knowledge curation."""
