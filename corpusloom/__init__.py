"""Spark-native analytics over document corpora: chunking, retrieval, fusion, evaluation."""

__version__ = "0.1.0"
