"""Document retrieval, grounded answering and retrieval evaluation as Spark DataFrame transformations."""
