"""Marketplace analytics as lazy PySpark DataFrames."""
