"""Settlement reconciliation as Spark jobs."""
