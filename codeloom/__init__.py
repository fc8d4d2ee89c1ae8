"""Spark-native code-knowledge-graph, retrieval and corpus-preparation engine."""
