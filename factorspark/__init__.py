"""Equity factor analytics expressed as Spark DataFrame jobs."""
