"""Barloom: market-research tables and text corpora as Spark DataFrame jobs."""
