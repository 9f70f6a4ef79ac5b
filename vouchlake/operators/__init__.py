"""Operators over DataFrames: grouping, matching, extraction, layout, checks and reports."""
