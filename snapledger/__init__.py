"""Snapshot monitoring over landed tables, expressed as PySpark DataFrame plans."""
