"""Column functions built only from Spark's own expressions."""
