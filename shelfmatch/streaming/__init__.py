"""Incremental loading of vector tables."""
