"""Spark-native analytics over collections of small graphs."""
