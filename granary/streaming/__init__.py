"""Streams of observations and frames."""
