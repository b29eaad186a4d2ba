"""Multiway hypergraph rewriting on Spark DataFrames."""
