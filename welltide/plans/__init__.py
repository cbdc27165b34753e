"""Registered queries by family."""

import importlib
import pkgutil


def load_all() -> None:
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
