"""Operators on DataFrames and the numpy kernels behind the grouped ones."""
