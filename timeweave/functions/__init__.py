"""Scalar, aggregate and temporal functions of the query language."""
