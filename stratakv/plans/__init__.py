"""Whole jobs made of operators and sources."""
