"""All registered queries; importing this package fills the registry."""

import importlib
import pkgutil

from millrace.catalog.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name != "registry":
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
