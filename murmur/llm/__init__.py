"""Operators for preparing training text; nothing else in murmur imports them."""
