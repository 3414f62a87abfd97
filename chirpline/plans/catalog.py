"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scoring", "curves", "tables", "signals")


def _plans():
    return [import_module(f"chirpline.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {name: f for m in _plans() for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _plans() for name, sql in m.O.items()}
