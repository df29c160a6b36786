"""Scalar text functions as Column expressions, and vectorised UDFs where Spark has none."""
