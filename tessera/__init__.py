"""Tessera: dataset, scoring and evaluation analytics on Spark DataFrames."""
