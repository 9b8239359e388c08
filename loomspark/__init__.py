"""Relational queries, relations, storage and migrations on Spark DataFrames."""
