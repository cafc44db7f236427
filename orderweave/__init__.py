"""Order-level market-event analytics as Spark DataFrame jobs."""
