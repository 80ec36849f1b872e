"""Page analytics on Spark."""
