"""Evidence and context analytics on Spark."""
