"""Retail and marketing analytics as PySpark DataFrame operators.

Every operator takes DataFrames and column names and returns a lazy DataFrame
built from native Spark expressions.
"""
