"""Analytics operators on PySpark DataFrames, Spark SQL and Structured Streaming."""
