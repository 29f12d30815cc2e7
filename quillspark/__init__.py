"""Document-quality and request-lifecycle analytics, expressed as Spark DataFrames."""
