"""Operators of a training-data pipeline.

Nothing else in the package imports this folder.  Every operator has a general
interface in its own module; ``queries`` holds the thin registered queries and
``oracles`` their SQL.
"""
