"""Vehicle-market analytics as Spark jobs."""
