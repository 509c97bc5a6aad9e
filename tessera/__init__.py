"""Tessera: a PySpark-native engine for reconciling curated sources."""
