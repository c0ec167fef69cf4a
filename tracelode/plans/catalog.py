"""All registered questions."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def _load() -> None:
    from .. import plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{plans.__name__}.{module.name}")


def questions() -> dict[str, registry.Question]:
    _load()
    return dict(registry.QUESTIONS)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
