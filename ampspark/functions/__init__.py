"""Functions of the read-clustering engine."""
