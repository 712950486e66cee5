"""Incident analytics on Spark DataFrames."""
