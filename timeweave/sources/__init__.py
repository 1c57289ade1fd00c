"""Readers and the graph views built over tables."""
