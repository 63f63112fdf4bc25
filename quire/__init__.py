"""Quire: manuscript-text analytics expressed as Spark DataFrames."""
