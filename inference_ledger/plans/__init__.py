"""Registered query plans (``queries()``) and their DuckDB oracle SQL."""
