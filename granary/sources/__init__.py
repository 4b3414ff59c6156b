"""Observation views over the tables, media scans, and scorer hooks."""
