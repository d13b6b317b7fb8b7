"""Multilingual text analytics on Spark DataFrames."""
