"""Spark-native index and analytics over source-code corpora."""
