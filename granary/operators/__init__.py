"""Operators over tables of observations."""
