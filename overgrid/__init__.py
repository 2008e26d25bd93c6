"""Weighted overlay analytics on gridded data, as Spark DataFrames."""

