"""barloom: market time-series analytics as Spark DataFrame jobs."""
