"""Readers, source adapters and writers."""
