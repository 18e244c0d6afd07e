"""Registry-monitoring analytics and corpus preparation as Spark DataFrame jobs."""
