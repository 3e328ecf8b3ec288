"""Scanlake: a PySpark-native analytics engine for scanned-document pipelines."""
