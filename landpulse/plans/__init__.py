"""Named queries over the test tables, each with its SQL check."""

from __future__ import annotations

from importlib import import_module

MODULES = ["sources", "text", "extraction", "features", "timeline", "quality", "audit", "modeling", "explain", "risk", "serving"]


def load():
    """All queries and their SQL, by name."""
    for module in MODULES:
        import_module(f"landpulse.plans.{module}")
    registry = import_module("landpulse.plans.registry")
    return dict(registry.QUERIES), dict(registry.ORACLES)
