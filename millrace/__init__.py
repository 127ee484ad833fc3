"""Live document search as Spark jobs."""
