"""Operators: DataFrames in, DataFrames out. None collects rows or runs Python on them."""
