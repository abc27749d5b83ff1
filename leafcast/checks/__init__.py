"""Verification helpers: SQL twins of the queries and a side-by-side comparator."""
