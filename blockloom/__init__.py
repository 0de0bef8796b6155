"""On-chain event analytics as Spark jobs."""
