"""Whole jobs, from source tables to results."""
