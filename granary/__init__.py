"""granary: a Spark-first engine for retail transaction analytics."""
