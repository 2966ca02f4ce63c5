"""All named queries; importing the modules registers them."""

import importlib

from .registry import ORACLES, QUERIES

MODULES = [
    "scans", "projections", "joins", "aggregates", "rankings", "sets", "splits", "texts", "values",
    "knowledge", "variants", "features", "models", "evaluation", "distances", "quality", "streams", "surface",
]

for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["QUERIES", "ORACLES"]
