"""Timbrewell: preset analytics and corpus processing on PySpark."""
