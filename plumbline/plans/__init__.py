"""Queries over the driver's tables, with SQL that should give the same."""
