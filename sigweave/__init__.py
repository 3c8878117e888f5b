"""sigweave: graded observations to ranked, explained conclusions, as Spark DataFrame jobs."""
