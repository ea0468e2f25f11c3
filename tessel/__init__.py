"""Spark-native curation of labelled text pairs and evaluation of retrieval over them."""

__version__ = "0.1.0"
