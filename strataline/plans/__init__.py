"""Composed queries: search, read, context and the calls that callers make."""
