"""SQL equivalents of the registered queries."""

from __future__ import annotations

from . import queries as _queries  # noqa: F401  registers both sides
from .registry import ORACLES

__all__ = ["ORACLES"]
