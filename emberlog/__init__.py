"""emberlog: application-log search and request tracing on Spark DataFrames."""
