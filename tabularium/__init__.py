"""Spark-native analytics over typed science-style tables."""
