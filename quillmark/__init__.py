"""Spark-native hybrid retrieval, citation-graph and compliance analytics."""
