"""Registered queries: fixture views over the given tables, Spark plans and their SQL twins."""
