"""Catalog operators: DataFrames in, a lazy DataFrame out."""
