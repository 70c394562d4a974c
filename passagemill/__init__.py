"""Spark-native passage retrieval and corpus analytics."""
