"""Bar-series regime analytics on Spark."""
