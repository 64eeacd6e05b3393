"""Corvane: a Spark-first engine that curates text corpora into training and retrieval data."""

__version__ = "0.1.0"
