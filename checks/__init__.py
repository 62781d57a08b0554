"""Registered queries and the DuckDB statements they are compared with."""
