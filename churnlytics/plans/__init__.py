"""Registered queries over the test tables and their DuckDB oracle SQL."""
