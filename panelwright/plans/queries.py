"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES

for _module in ("panel_queries", "factor_queries", "portfolio_queries", "audit_queries", "stats_queries", "validation_queries", "search_queries", "decision_queries", "bench_queries"):
    import_module(f"{__package__}.{_module}")

__all__ = ["QUERIES"]
