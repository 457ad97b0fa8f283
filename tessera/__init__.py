"""Document knowledge analytics on PySpark."""
