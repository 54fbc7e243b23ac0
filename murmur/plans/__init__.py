"""Whole jobs, views over the test tables, the query registry."""
