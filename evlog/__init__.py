"""Security-event log normalisation as Spark jobs."""
