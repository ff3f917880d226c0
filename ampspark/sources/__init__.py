"""Sources of the read-clustering engine."""
