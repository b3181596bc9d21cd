"""Registered queries: analog views over the given tables, and their SQL twins."""
