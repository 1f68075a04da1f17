"""Column functions: text, time and JSON, all built from Spark's own expressions."""
