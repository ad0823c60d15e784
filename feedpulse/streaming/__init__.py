"""Structured Streaming jobs with bounded state and idempotent sinks."""
