"""Tessera: a PySpark-native analytics engine for large text collections."""
