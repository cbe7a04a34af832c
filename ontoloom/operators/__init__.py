"""Reasoning operators: DataFrames in, DataFrames out."""
