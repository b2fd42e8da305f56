"""Analytics over media libraries and their metadata, on Spark."""
