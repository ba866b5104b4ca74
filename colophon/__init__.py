"""Catalogue and text-archive analytics on Spark DataFrames."""
