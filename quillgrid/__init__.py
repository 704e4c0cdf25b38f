"""Spark-native analytics over collections of lightweight-markup documents."""
