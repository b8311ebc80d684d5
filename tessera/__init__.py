"""Ownership analytics on Spark DataFrames: sources, column functions, operators, plans and incremental ingest."""
