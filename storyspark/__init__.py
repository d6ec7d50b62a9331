"""News and public-record analytics as Spark DataFrame and Structured Streaming operators."""
