"""Registered end-to-end queries (one per inventory ID) and their DuckDB oracle SQL."""
