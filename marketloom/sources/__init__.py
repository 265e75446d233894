"""Sources of the listings engine."""
