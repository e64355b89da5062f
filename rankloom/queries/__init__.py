"""Queries over the given tables, with SQL that gives the same rows."""
