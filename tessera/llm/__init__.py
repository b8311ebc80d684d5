"""Training-data operators. Nothing outside this package imports it; queries() and oracle_sql() are its registry."""
