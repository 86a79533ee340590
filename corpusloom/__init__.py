"""Document retrieval analytics as Spark DataFrame functions."""
