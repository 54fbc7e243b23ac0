"""The batch functions on Structured Streaming."""
