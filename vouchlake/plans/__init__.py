"""Whole queries: the audit model on the driver's tables."""
