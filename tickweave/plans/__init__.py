"""Every runnable query, grouped by subject."""

import importlib
import pkgutil

from tickweave.plans.registry import ORACLES, QUERIES


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
