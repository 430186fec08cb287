"""Registered queries over the driver tables, and the SQL they are checked with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("columns", "reads", "models", "ingestion", "publishing", "specified")


def all_queries():
    """``(queries, oracles)`` of every module, by operator id."""
    from claimgraph.plans import registry

    for name in MODULES:
        import_module(f"claimgraph.plans.{name}")
    return (
        dict(sorted(registry.QUERIES.items())),
        dict(sorted(registry.ORACLES.items())),
    )
