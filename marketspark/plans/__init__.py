"""Registered queries over the given tables, with their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module and return (queries, sql)."""
    from marketspark.plans import registry

    for m in sorted(x.name for x in pkgutil.iter_modules(__path__) if x.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLES
