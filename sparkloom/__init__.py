"""Document retrieval, text preparation and run analytics as plain Spark DataFrame programs."""
