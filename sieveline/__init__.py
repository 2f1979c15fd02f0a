"""Spark-native analytics for set-compositional retrieval."""
