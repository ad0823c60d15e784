"""Import every query module so that the registry is complete."""

from __future__ import annotations

from . import q_mentions, q_models, q_news, q_sources, q_stats, q_streams, q_text  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
