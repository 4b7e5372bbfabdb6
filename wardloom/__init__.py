"""Spark-native analytics over free-text clinical documents."""
