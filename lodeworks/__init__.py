"""Lodeworks: document evidence, retrieval and corpus work as Spark plans."""

__version__ = "0.1.0"
