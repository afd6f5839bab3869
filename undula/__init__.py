"""Functional time-series analytics on PySpark: curves as DataFrames of arrays."""
