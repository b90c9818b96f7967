"""All registered queries; each plan module contributes ``QUERIES`` and ``ORACLES``."""

from __future__ import annotations

from importlib import import_module

MODULES = ("intervals", "identity", "evidence", "consensus", "design", "cells", "cnv", "response", "vectors",
           "statistics", "quality", "sources")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        entries = getattr(import_module(f"lociframe.plans.{name}"), attribute)
        repeated = merged.keys() & entries.keys()
        if repeated:
            raise ValueError(f"query registered twice: {sorted(repeated)}")
        merged.update(entries)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
