"""Corpus preparation, retrieval, log analytics and retrieval evaluation as Spark jobs."""

__version__ = "0.1.0"
