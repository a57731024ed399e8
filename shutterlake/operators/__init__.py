"""Catalog, identity, stack, similarity and job operators: pure functions from DataFrames to DataFrames."""
