"""Operators for preparing training text: deduplication, scoring, extraction, tokens and archives.

Every operator takes DataFrames and returns DataFrames. Nothing else in the package imports this subpackage.
"""
