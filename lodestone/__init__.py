"""Corpus analytics on PySpark: blocks, search, code graph, vectors, snapshots and streams."""

__version__ = "0.2"
