"""Queries over the views, and their SQL."""
