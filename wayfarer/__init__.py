"""Visitor and web analytics on Spark DataFrames."""
