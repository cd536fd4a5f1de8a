"""Corvine: code search, code-graph and corpus analytics on Spark DataFrames."""
