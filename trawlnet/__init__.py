"""Document retrieval and its evaluation as Spark DataFrame operators."""
