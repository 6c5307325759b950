"""Registered queries and the SQL they are checked against, one module per area."""

from __future__ import annotations

import importlib

AREAS = ["boxes", "matching", "scoring", "tiles", "reading", "graphs", "inkwork", "answers", "exchange"]


def _collect(what: str) -> dict:
    out: dict = {}
    for area in AREAS:
        out.update(getattr(importlib.import_module(f"checks.{area}"), what))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
