"""Operators over DataFrames: each returns a new lazy DataFrame."""
