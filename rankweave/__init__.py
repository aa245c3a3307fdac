"""Rank/select analytics over integer sets, multisets and symbol sequences, on Spark DataFrames."""
