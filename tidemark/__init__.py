"""Time-series analytics and corpus processing on Spark."""
