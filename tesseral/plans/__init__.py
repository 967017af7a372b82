"""Whole queries: airspace reservation, compression analysis, and the catalogue with its SQL."""
