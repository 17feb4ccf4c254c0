"""Site analytics on Spark."""
