"""Kithline: record linkage and text preparation on Spark DataFrames."""
