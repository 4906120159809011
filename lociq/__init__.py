"""Spatial variant analytics expressed as Spark DataFrame jobs."""
