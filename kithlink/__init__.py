"""Person-record linkage and its evaluation as Spark DataFrame operators."""
