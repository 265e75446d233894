"""Plans of the listings engine."""
