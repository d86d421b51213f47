"""Document-corpus analytics on Spark."""
