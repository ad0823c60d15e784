"""Readers for landed tables and record adapters over the driver tables."""
