"""Document-pool analytics as Spark DataFrame jobs."""
