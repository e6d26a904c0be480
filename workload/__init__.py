"""Every operator as a query over the driver tables, with its SQL check."""

from __future__ import annotations

import importlib

MODULES = ("columns", "keyed", "counts", "scanning", "ordered", "statistics", "files", "streams", "stored")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")


def all_queries() -> dict:
    _load()
    from workload.registry import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    from workload.registry import ORACLES

    return dict(ORACLES)
