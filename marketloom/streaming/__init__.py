"""Streaming of the listings engine."""
