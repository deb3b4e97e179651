"""Whole queries over tables, and the catalogue of them."""
