"""Keyed index operators over Spark DataFrames."""
