"""Queries over the driver's tables, each with the SQL of the same result."""
