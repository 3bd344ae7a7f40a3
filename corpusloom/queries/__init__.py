"""Named queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that register queries.
MODULES = ("search", "texts", "tables", "views", "papers", "corpus", "files", "structures")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
