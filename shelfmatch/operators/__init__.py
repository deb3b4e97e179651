"""Operators on DataFrames: products, lookups, search, classification, evaluation and reports."""
