"""Readers, parsers of landed data, writers."""
