"""Market time-series analytics as Spark DataFrame and Structured Streaming jobs."""
