"""sluice: tabular data preparation, model search and corpus work as Spark jobs."""
