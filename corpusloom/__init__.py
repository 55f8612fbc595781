"""Literature-monitoring analytics as Spark DataFrame jobs."""
