"""Registered queries over the driver tables, each with SQL that says the same."""

from importlib import import_module

_MODULES = ["logs", "tables", "datasets", "evaluation", "dashboards", "detection", "models", "streams"]


def load():
    """Import all query modules once; returns the registry."""
    for name in _MODULES:
        import_module(f"palisade.catalog.{name}")
    return import_module("palisade.catalog.registry")
