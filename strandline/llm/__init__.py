"""Operators for training text and retrieval data. Optional: the rest of the library does not import this package."""
