"""Tidemark: point-in-time panel research and data processing on PySpark."""
