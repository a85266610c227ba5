"""Marketplace-listing analytics on PySpark: DataFrame, SQL and Structured Streaming operators."""
