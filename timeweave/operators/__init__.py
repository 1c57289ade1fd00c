"""Operators over node, edge, history and interval DataFrames."""
