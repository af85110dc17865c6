"""Head-to-head rating analytics on Spark."""
