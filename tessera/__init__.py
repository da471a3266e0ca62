"""Dense-array and image analytics as Spark jobs."""
