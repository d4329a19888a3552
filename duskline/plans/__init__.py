"""Registered queries of the analytics operators, with their DuckDB oracles."""
