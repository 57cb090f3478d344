"""Queries over the given tables, and the same in SQL: checks of this package, not part of it."""
