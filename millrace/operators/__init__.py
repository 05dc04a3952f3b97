"""Operators over DataFrames: each takes frames and parameters, returns a lazy frame."""
