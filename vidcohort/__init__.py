"""Benchmarking of large video catalogues on Spark DataFrames."""
