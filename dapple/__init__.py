"""Label-distribution analytics on Spark: DataFrame operators, sources, functions and query plans."""
