"""Spatiotemporal cell analytics, and corpus operators, as Spark DataFrame programs."""
