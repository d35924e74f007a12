"""Driftline: release-by-release API support analytics on Spark DataFrames."""
