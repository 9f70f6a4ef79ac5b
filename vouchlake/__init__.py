"""Vouchlake: a PySpark-native engine for audit tests of detail on revenue."""

__version__ = "0.1.0"
