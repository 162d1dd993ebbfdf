"""Equity analytics as Spark DataFrame jobs."""
