"""Tidemark: market-microstructure time-series analytics on PySpark DataFrames."""
