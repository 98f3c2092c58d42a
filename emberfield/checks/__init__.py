"""Registered queries and their SQL twins."""

from importlib import import_module

MODULES = ("tables", "formulas", "pixels", "places", "choices")


def load_all():
    """(queries, oracles) of all check modules."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    registry = import_module(f"{__name__}.registry")
    return registry.QUERIES, registry.ORACLES
