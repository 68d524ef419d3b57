"""Duplicate and near-duplicate analytics on Spark DataFrames."""
