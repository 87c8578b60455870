"""Vitrine: marketplace analytics as PySpark DataFrame jobs."""
