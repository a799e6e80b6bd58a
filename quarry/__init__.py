"""A Spark-first analytics engine: Presto-dialect query semantics on DataFrames and Spark SQL."""
