"""Query plans over the driver tables."""

from __future__ import annotations

import importlib
import pkgutil

from kinetable.plans.registry import REGISTRY, Entry


def load_all() -> dict[str, Entry]:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return dict(REGISTRY)
