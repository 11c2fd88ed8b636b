"""Registered queries with their DuckDB counterparts."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every registry module and return the collected tables."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.base")
