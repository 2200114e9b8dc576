"""Tilewright: a Spark-native audit engine for city models, tilesets and training corpora."""
