"""Photo-library analytics and corpus preparation as plain Spark DataFrame jobs."""
