"""Batch analytics over industrial sensor readings, written for Spark DataFrames."""
