"""loregraph: knowledge analytics as Spark DataFrame jobs."""
