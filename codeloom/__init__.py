"""Spark-native analytics over code-entity datasets."""
