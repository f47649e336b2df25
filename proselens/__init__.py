"""Prose analytics on Spark: every document is a row, every analysis a DataFrame transformation."""
