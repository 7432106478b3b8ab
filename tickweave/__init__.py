"""Volatility and regime analytics for large collections of ordered series, on PySpark."""
