"""Registered queries over the given tables, each beside the SQL it must equal."""
from folioscope.plans.registry import ORACLES, QUERIES


def _load() -> None:
    import importlib

    for name in ("catalog", "review", "export", "text", "geometry", "reading", "index", "stream"):
        importlib.import_module(f"folioscope.plans.{name}_queries")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
