"""All registered queries and their SQL checks."""

from importlib import import_module

AREAS = ("features", "sources", "evaluation", "retrieval", "streams")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _area in AREAS:
    _module = import_module(f"asofkit.catalog.{_area}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
