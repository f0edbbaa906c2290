"""Tamarind: a PySpark-native engine for multilingual market-evidence data."""

__version__ = "0.1.0"
