"""Joins, de-duplication, aggregation, windows, decisions."""
