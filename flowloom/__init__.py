"""Network traffic analytics on Spark."""
