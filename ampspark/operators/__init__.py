"""Operators of the read-clustering engine."""
