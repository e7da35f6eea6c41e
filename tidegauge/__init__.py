"""Leakage-safe panel time-series operators on Spark DataFrames."""
