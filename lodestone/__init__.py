"""A Spark engine for code intelligence."""
