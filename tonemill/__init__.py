"""tonemill: the data work around text classification, as Spark DataFrame jobs."""
