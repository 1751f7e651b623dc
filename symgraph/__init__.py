"""Spark-native hybrid search and dependency navigation over code-and-definition corpora."""
