"""Product-review retrieval on Spark: parse, index, look up and rank."""
