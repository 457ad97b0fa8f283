"""The catalogue of queries with their SQL."""
